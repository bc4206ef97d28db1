"""What tokenizer files of the ``tokenizers`` library hold, and two exact encoders built on it."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from functools import cache
from itertools import count, islice

import numpy as np

#: Fixed value: how byte-level tokenizers of this kind split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_KEPT = 400_000


@cache
def alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and ranked merges of a file, as ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            whole = a[: len(a) - len(self.end)] + b if self.end and a.endswith(self.end) else a + b
            self.rank.setdefault((self.vocab[a], self.vocab[b]), (r, self.vocab[whole]))

    def merged(self, ids: list[int]) -> list[int]:
        """The ids after all merges, lowest rank first and leftmost of equals."""
        rank, none = self.rank, (1 << 60, -1)
        while len(ids) > 1:
            best, at = min((rank.get(p, none), i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
            if best is none or best[1] < 0:
                break
            ids = [*ids[:at], best[1], *ids[at + 2 :]]
        return ids


class PrefixCounter:
    """Exact token counts of every prefix of a text, for a byte-level tokenizer.

    Inside a pretoken: the encoding of each prefix ends in exactly one token that can follow the encoding of
    what precedes it (two tokens can stand side by side if encoding both together gives them
    again). So the count at byte i is the count at byte i - |last token| plus one, and one pass gives all.
    Across pretokens counts add up. Where cutting a text changes its last pretoken (white space before a
    word, half a contraction, half a special string) the cut piece has its own count.
    Results for units and pretokens are kept, up to a bound, as texts repeat them."""

    def __init__(self, path: str):
        import regex

        self.merges = m = Merges(path)
        chars = alphabet()
        self.bytes_of = {i: bytes(chars[c] for c in t) for t, i in m.vocab.items() if all(c in chars for c in t)}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.byte_id = [self.id_of[bytes([b])] for b in range(256)]
        self.longest = max(map(len, self.id_of))
        self._split = regex.compile(SPLIT).findall
        self.blank = regex.compile(r"\s+").fullmatch
        self._path, self._library = path, None
        self.special = re.compile("|".join(map(re.escape, sorted(m.special, key=len, reverse=True)))) if m.special else None
        self.pieces: dict[str, list[int]] = {}
        self.after_space: dict[str, int] = {}
        self.at_start: dict[str, int] = {}
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def split(self, text: str) -> list[str]:
        """The pretokens. Characters that Unicode versions class differently go through the library's own splitter."""
        if text.isascii() or max(text) < LATER:
            return self._split(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path).pre_tokenizer
        chars = alphabet()
        return [bytes(chars[c] for c in p).decode() for p, _ in self._library.pre_tokenize_str(text)]

    def alone(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        if token not in self.whole:
            self.whole[token] = self.merges.merged([self.byte_id[b] for b in self.bytes_of[token]]) == [token]
        return self.whole[token]

    def follows(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 4 * MOST_KEPT:
                self.fits.clear()
            known = self.fits[key] = self.alone(b) and self.merges.merged([self.byte_id[x] for x in self.bytes_of[a] + self.bytes_of[b]]) == [a, b]
        return known

    def piece(self, pretoken: str) -> list[int]:
        """Token counts of the pretoken's byte prefixes, from the empty one on."""
        if pretoken not in self.pieces:
            self.learn([pretoken])
        return self.pieces[pretoken]

    def learn(self, pretokens: list[str]) -> None:
        """Counts for many pretokens. In byte order, each goes on from the prefix it shares with the one before."""
        if len(self.pieces) > MOST_KEPT:
            self.pieces.clear()
        token, fits, longest = self.id_of.get, self.fits, self.longest
        before, count, last = b"", [0], [-1]
        for w, pretoken in sorted((p.encode(), p) for p in pretokens):
            shared = 0
            for x, y in zip(before, w, strict=False):
                if x != y:
                    break
                shared += 1
            del count[shared + 1 :], last[shared + 1 :]
            for i in range(shared + 1, len(w) + 1):
                for j in range(max(0, i - longest), i):
                    t = token(w[j:i])
                    if t is None:
                        continue
                    a = last[j]
                    if a < 0:
                        if not self.alone(t):
                            continue
                    else:
                        good = fits.get(a << 20 | t)
                        if not (self.follows(a, t) if good is None else good):
                            continue
                    count.append(count[j] + 1)
                    last.append(t)
                    break
            self.pieces[pretoken] = count[:]
            before = w

    def unit(self, text: str) -> int:
        """The token count of a text that starts and ends where pretokens do."""
        if self.special and (cuts := list(self.special.finditer(text))):
            ends = [0, *(m.end() for m in cuts)]
            starts = [*(m.start() for m in cuts), len(text)]
            return len(cuts) + sum(self.unit(text[a:b]) for a, b in zip(ends, starts, strict=True))
        return sum(self.piece(p)[-1] for p in self.split(text))

    def count(self, text: str) -> int:
        """The token count of the whole text."""
        return self.counts([text])[0]

    def counts(self, texts: list[str]) -> list[int]:
        """The token counts of whole texts.

        Units part before a blank between two characters that aren't white space: no pretoken crosses there."""
        parts = [_PARTS(t) if _RUNS(t) else t.split(" ") for t in texts]
        kept = self.after_space
        if len(kept) > MOST_KEPT:
            kept.clear()
        new = [u for u in set().union(*(p[1:] for p in parts)) if u not in kept]
        plain = [u for u in new if not self.special or not self.special.search(u)]
        cut = [self.split(" " + u) for u in plain]
        self.learn(list({p for c in cut for p in c if p not in self.pieces}))
        pieces = self.pieces
        for u, c in zip(plain, cut, strict=True):
            kept[u] = pieces[c[0]][-1] if len(c) == 1 else sum(pieces[p][-1] for p in c)
        if len(plain) < len(new):
            kept.update((u, self.unit(" " + u)) for u in set(new).difference(plain))
        known = kept.__getitem__
        return [sum(map(known, p[1:])) + self.unit(p[0]) for p in parts]

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where the units of a text start, and the token count of the text before each."""
        parts = _PARTS(text) if _RUNS(text) else text.split(" ")
        known = self.after_space.get
        counts = [self.unit(parts[0])]
        for u in parts[1:]:
            n = known(u)
            counts.append(self.unit(" " + u) if n is None else n)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        lengths[1:] += 1
        return np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.concatenate([[0], np.cumsum(counts)[:-1]])

    def prefixes(self, text: str) -> np.ndarray:
        """The token count of text[:i] for each i from 0 to its length."""
        out = np.zeros(len(text) + 1, np.int64)
        base = at = 0  # tokens before ``at``, which is the start of the text or the end of a special string
        stops = list(self.special.finditer(text)) if self.special else []
        for stop in [*stops, None]:
            end = stop.start() if stop else len(text)
            tail = self._segment(text[at:end], base, out[at : end + 1])
            if stop is None:
                break
            # a cut within the special string leaves plain text, which may join the last pretoken
            start, before = at + tail[0], tail[1]
            for i in range(end + 1, stop.end()):
                out[i] = before + sum(self.piece(p)[-1] for p in self.split(text[start:i]))
            base, at = int(out[end]) + 1, stop.end()
            out[at] = base
        return out

    def _segment(self, text: str, base: int, out: np.ndarray) -> tuple[int, int]:
        """Fills in the counts of a text without special strings. Returns where its last pretoken starts, and the count before it."""
        at, n = 0, base
        out[0] = base
        start, before = 0, base
        pretokens, blank = self.split(text), self.blank
        i = 0
        while i < len(pretokens):
            p = pretokens[i]
            start, before = at, n
            if blank(p):
                # up to a cut, white space is one pretoken
                run = p
                if i + 1 < len(pretokens) and blank(pretokens[i + 1]):
                    run += pretokens[i + 1]
                self._spread(run, n, out[at:])
                n += self.piece(p)[-1]
                at += len(p)
                out[at] = n
                if len(run) > len(p):
                    rest = pretokens[i + 1]
                    whole = self.piece(run)
                    n += self.piece(rest)[-1]
                    at += len(rest)
                    # a cut here ends in the whole run
                    out[at] = before + whole[-1]
                    start, before = at - len(run), before
                    if i + 2 >= len(pretokens):
                        out[at] = n
                    i += 1
                elif i + 1 < len(pretokens) and pretokens[i + 1][0] == " " and len(pretokens[i + 1]) > 1:
                    joined = self.piece(p + " ")[-1]
                    i += 1
                    q = pretokens[i]
                    start, before2 = at, n
                    self._inside(q, n, out[at:])
                    out[at + 1] = before + joined
                    n += self.piece(q)[-1]
                    at += len(q)
                    out[at] = n if len(q) > 1 else out[at]
                    before = before2
            else:
                self._inside(p, n, out[at:])
                n += self.piece(p)[-1]
                at += len(p)
            i += 1
        return start, before

    def _inside(self, p: str, n: int, out: np.ndarray) -> None:
        self._spread(p, n, out)
        if len(p) == 3 and p in ("'re", "'ve", "'ll"):  # half of it is a mark and a letter
            out[2] = n + self.piece("'")[-1] + self.piece(p[1])[-1]

    def _spread(self, p: str, n: int, out: np.ndarray) -> None:
        counts = self.piece(p)
        if p.isascii():
            out[1 : len(p) + 1] = np.add(counts[1:], n)
            return
        at = 0
        for i, c in enumerate(p, 1):
            at += len(c.encode())
            out[i] = n + counts[at]


_RUNS = re.compile(r"\s\s|\A\s|\s\Z").search
_PARTS = re.compile(r"(?<=\S) (?=\S)").split


class WordEncoder:
    """Ids of texts for a tokenizer that lowers letters, drops white space and marks word ends.

    The ids of a text are those of its pretokens (words, single digits, runs of marks), so these are numbered, encoded once and
    kept. Above a bound only the half that was used most goes on being kept. New ones are
    merged many at a time, in numpy: all of a length side by side, each step applying to each its
    best-ranked pair. Stretches between white space beyond printable Latin-1 or with special strings, and
    long pretokens, go through the library."""

    LONG, MOST = 48, 200_000

    def __init__(self, path: str):
        self.path, self.library = path, None  # the library is loaded when a stretch needs it
        self.merges = m = Merges(path)
        char = {b: c for c, b in alphabet().items()}
        self.inner = np.array([m.vocab.get(char[b], -1) for b in range(256)], np.int64)
        self.final = np.array([m.vocab.get(char[b] + m.end, -1) for b in range(256)], np.int64)
        pairs = sorted((a << 20 | b, r, w) for (a, b), (r, w) in m.rank.items())
        self.keys, self.ranks, self.wholes = (np.array([p[i] for p in pairs], np.int64) for i in range(3))
        self.ranks = self.ranks.astype(np.int32)
        self.forget()

    def forget(self) -> None:
        """Keeps nothing."""
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return self.encode_many([text])[0].tobytes()

    def encode_many(self, texts: list[str], together: int = 4_000_000) -> list[np.ndarray]:
        """The ids of each text; about so many characters are held as pretokens at once."""
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size > together:
                out += self._encoded(some)
                some, size = [], 0
        return out + self._encoded(some)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > self.MOST:
            self._trim()
        number = self.number.__getitem__
        odd = {i for i, t in enumerate(texts) if _ODD(t)}  # white space to Python that the tokenizer keeps
        parts = []
        for i, t in enumerate(texts):
            p = [] if i in odd else pretokens(t)
            parts.append(np.fromiter(map(number, p), np.int32, len(p)))
        self._learn(list(islice(self.number, len(self.size), None)))
        out = []
        for p in parts:
            self.uses += np.bincount(p, minlength=len(self.uses)) if len(p) > 4096 else 0
            if len(p) <= 4096:
                np.add.at(self.uses, p, 1)
            sizes = self.size[p]
            ends = np.cumsum(sizes)
            out.append(self.ids[np.repeat(self.start[p] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)])
        for i, ids in zip(sorted(odd), self.by_library([texts[i] for i in sorted(odd)]), strict=True):
            out[i] = ids
        return out

    def by_library(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        odd = [i for i, p in enumerate(new) if len(p) > self.LONG or (not (p.isalnum() and p.isascii()) and _BEYOND(p))]
        special = set(odd)
        plain = [i for i in range(len(new)) if i not in special]
        found: list = [None] * len(new)
        for i, ids in zip(odd, self.by_library([new[i] for i in odd]), strict=True):
            found[i] = ids.tobytes()
        for i, ids in zip(plain, self.merge([new[i] for i in plain]), strict=True):
            found[i] = ids
        sizes = np.fromiter((len(x) // 4 for x in found), np.int64, len(found))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), "<u4")])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def _trim(self) -> None:
        best = np.sort(np.argsort(-self.uses, kind="stable")[: self.MOST // 2])
        words = list(self.number)
        sizes, starts, ids, uses = self.size[best], self.start[best], self.ids, self.uses[best]
        kept = [words[i] for i in best.tolist()]
        self.forget()
        self.number.update((w, self.number.default_factory()) for w in kept)
        ends = np.cumsum(sizes)
        self.ids = ids[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self.start, self.size, self.uses = ends - sizes, sizes, uses // 2

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged ids of pairs; the rank is the largest number where there is none."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = self.keys[at] == key
        return np.where(good, self.ranks[at], NONE), self.wholes[at]

    def merge(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(words)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        for n in np.unique(sizes).tolist():
            rows = np.nonzero(sizes == n)[0]
            data = np.frombuffer(b"".join(raw[i] for i in rows), np.uint8).reshape(len(rows), n)
            ids = self.inner[data]
            ids[:, -1] = self.final[data[:, -1]]
            length = n
            while length > 1 and len(rows):
                if length == n:
                    rank, whole = self.lookup(ids[:, :-1], ids[:, 1:])
                at = rank.argmin(axis=1)
                every = np.arange(len(rows))
                going = rank[every, at] != NONE
                if not going.all():
                    for i, row in zip(rows[~going].tolist(), ids[~going].astype("<u4"), strict=True):
                        out[i] = row.tobytes()
                    rows, ids, rank, whole, at = rows[going], ids[going], rank[going], whole[going], at[going]
                    every = np.arange(len(rows))
                ids[every, at] = whole[every, at]
                length -= 1
                column = np.arange(length)
                ids = np.take_along_axis(ids, column + (column > at[:, None]), 1)
                if length == 1:
                    break
                column = np.arange(length - 1)
                shift = column + (column >= at[:, None])
                rank, whole = np.take_along_axis(rank, shift, 1), np.take_along_axis(whole, shift, 1)
                left = at > 0
                rank[every[left], at[left] - 1], whole[every[left], at[left] - 1] = self.lookup(ids[every[left], at[left] - 1], ids[every[left], at[left]])
                right = at < length - 1
                rank[every[right], at[right]], whole[every[right], at[right]] = self.lookup(ids[every[right], at[right]], ids[every[right], at[right] + 1])
            for i, row in zip(rows.tolist(), ids.astype("<u4"), strict=True):
                out[i] = row.tobytes()
        return out


#: From here on, characters may be letters in one version of Unicode and not in another.
LATER = "\u0558"
NONE = np.iinfo(np.int32).max
_ODD = re.compile(r"[\x1c-\x1f]").search
#: What is neither printable Latin-1 nor white space, or may start a special string.
_BEYOND = re.compile(r"[^\t-\r -~\xa0-\xff]|<\|").search
#: In lower-case Latin-1: what stands beside words. Between two of these, or one and a word, the tokenizer splits.
_BESIDE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\s0-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+").sub


def pretokens(text: str) -> list[str]:
    """The pretokens of a text in lower case; a stretch beyond printable Latin-1 stays one, as it is."""
    if not _BEYOND(text):
        return _BESIDE(r" \g<0> ", text.lower()).split()
    return [p for w in text.split() for p in ([w] if _BEYOND(w) else _BESIDE(r" \g<0> ", w.lower()).split())]


@cache
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)

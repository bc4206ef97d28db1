"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over every text.

Words are runs of ASCII letters and digits and of any character beyond ASCII, with A-Z lowered. A window is
``size`` consecutive words of an item; a shorter item (not an empty one) is a window as a whole. Windows
are hashed from word numbers in numpy; each hash that is found is verified word by word before it
counts. The set is broadcast in parts of a bounded size (``part_windows``): a benchmark of any size is
scanned in as many narrow passes as it needs, each handing its hits to the next as a column."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Carried, column_bytes, column_list, lean, pick, written

SIZE = 10
PART_WINDOWS = 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
HITS = "array<struct<first:int,last:int,item:string>>"


@cache
def _table() -> bytes:
    """Byte to byte: letters lowered, what parts words to a blank."""
    return bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_table()).split()


def windows_of(item: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    return [tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1))] if item else []


class HashSet:
    """The windows of some items, by length: sorted hashes of word numbers, and the words themselves to verify with."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]]):
        self.number: dict[bytes, int] = {}
        self.windows = windows
        lengths: dict[int, list] = {}
        for w in windows:
            lengths.setdefault(len(w), []).append(w)
            for x in w:
                self.number.setdefault(x, len(self.number) + 1)
        self.hashes = {n: np.unique(np.array([self._hash(np.array([self.number[x] for x in w], np.uint64), n)[0] for w in ws], np.uint64)) for n, ws in lengths.items()}

    @staticmethod
    def _hash(ids: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of n numbers."""
        out = np.zeros(len(ids) - n + 1, np.uint64)
        for i in range(n):
            out = (out ^ ids[i : len(ids) - n + 1 + i]) * MULTIPLIER
            out ^= out >> np.uint64(29)
        return out

    def hits(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, last word, item) of each occurrence of a window."""
        if not words:
            return []
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        found = []
        for n, hashes in self.hashes.items():
            if len(words) < n:
                continue
            starts = np.nonzero(unknown[n:] == unknown[:-n])[0]
            if not len(starts):
                continue
            h = self._hash(ids, n)[starts] if len(starts) * 2 > len(words) else self._at(ids, starts, n)
            place = np.searchsorted(hashes, h)
            place[place == len(hashes)] = 0
            for i in starts[hashes[place] == h].tolist():
                for item in self.windows.get(tuple(words[i : i + n]), ()):
                    found.append((i, i + n - 1, item))
        return found

    @staticmethod
    def _at(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for i in range(n):
            out = (out ^ ids[starts + i]) * MULTIPLIER
            out ^= out >> np.uint64(29)
        return out


def parts_of(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in parts of at most ``most`` words (an item is never split), so that each part's set has a proven bound.

    Rows stream to the driver one partition at a time; only one part and its set are held there at once."""
    held, n = [], 0
    for row in pick(benchmark, item_id, text).toDF("i", "t").where("t is not null").select(F.col("i").cast("string"), F.col("t").cast("binary")).toLocalIterator():
        if not (w := words_of(bytes(row[1]))):
            continue
        if held and n + len(w) > most:
            yield held
            held, n = [], 0
        held.append(("" if row[0] is None else row[0], b" ".join(w)))
        n += len(w)
    if held:
        yield held


def scan(docs: DataFrame, text: str, benchmark: DataFrame, item_id: str, item_text: str, then: Callable, schema, size: int = SIZE, most: int = PART_WINDOWS) -> DataFrame:
    """The table as ``then`` makes it (of ``schema``) from each batch and the hits of its rows: first and last word (from 0) of each
    occurrence, and the item's id. The last part of the benchmark is scanned for, and ``then`` applied, in one pass."""
    spark, extra = docs.sparkSession, "_earlier_hits"
    parts = parts_of(benchmark, item_id, item_text, most)
    part, following = next(parts, []), next(parts, None)
    kind = docs.withColumn(extra, F.expr(f"cast(array() as {HITS})")).schema

    def found(b, sent, names):
        held = _set(sent, size)
        before = column_list(b, extra) if extra in names else [[]] * b.num_rows
        return [h + [{"first": f, "last": la, "item": i} for f, la, i in held.hits(words_of(t))] for h, t in zip(before, column_bytes(b, text), strict=True)]

    while following is not None:  # passes run one after the other, or all parts would be in memory at once
        sent = spark.sparkContext.broadcast(part)

        def run(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            for b in batches:
                names = [*(x for x in b.schema.names if x != extra), extra]
                hits = pa.array(found(b, sent, b.schema.names), hits_type())
                yield pa.RecordBatch.from_arrays([hits if x == extra else b.column(k) for k, x in enumerate(names)], names=names)

        docs = written(docs.mapInArrow(lean(run), kind), "scanned")
        part, following = following, next(parts, None)
    sent = spark.sparkContext.broadcast(part)

    def last(batches: Iterator) -> Iterator:
        for b in batches:
            yield then(b, found(b, sent, b.schema.names))

    return docs.mapInArrow(lean(last), schema)


def hits_type():
    import pyarrow as pa

    return pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("item", pa.string())]))


_SETS: dict = {}


def _set(sent, size: int) -> HashSet:
    """The set of a broadcast part, made once in a worker."""
    if (sent.id if hasattr(sent, "id") else sent._path, size) not in _SETS:
        windows: dict[tuple, list[str]] = {}
        for item, joined in sent.value:
            for w in windows_of(joined.split(), size):
                ids = windows.setdefault(w, [])
                if item not in ids:
                    ids.append(item)
        _SETS.clear()
        _SETS[(sent.id if hasattr(sent, "id") else sent._path, size)] = HashSet(windows)
    return next(iter(_SETS.values()))


def hit_words(hits: list[dict], n: int) -> np.ndarray:
    """Which of n words lie in a hit."""
    edge = np.zeros(n + 1, np.int64)
    for h in hits:
        edge[h["first"]] += 1
        edge[h["last"] + 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def report(docs: DataFrame, doc_id: str, text: str, benchmark: DataFrame, item_id: str, item_text: str, size: int = SIZE, part_windows: int = PART_WINDOWS) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items (their ids, sorted as strings).

    A null or empty text has no words and is clean; so is everything if the benchmark is empty. Items
    alike in text all count; a null item id is the empty string. Repeated rows stay repeated."""
    import pyarrow as pa

    plain = pick(docs, doc_id, text).toDF("doc_id", "text")
    kind = plain.schema["doc_id"].dataType.simpleString()

    def told(b, found):
        n_words, n_hit, items = [], [], []
        for t, hits in zip(column_bytes(b, "text"), found, strict=True):
            n_words.append(len(words_of(t)))
            n_hit.append(int(hit_words(hits, n_words[-1]).sum()) if hits else 0)
            items.append(sorted({h["item"] for h in hits}))
        digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])

    return scan(plain, "text", benchmark, item_id, item_text, told, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>", size, part_windows)


def word_spans(text: str) -> list[tuple[int, int]]:
    """Code-point bounds of the words of a text, in order."""
    import re

    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


def cut(text: str, hits: list[dict]) -> str:
    """The text without the stretches from the first to the last word of each hit."""
    spans = word_spans(text)
    hit = hit_words(hits, len(spans))
    out, at, i = [], 0, 0
    while i < len(spans):
        if not hit[i]:
            i += 1
            continue
        first = i
        while i + 1 < len(spans) and hit[i + 1]:
            i += 1
        out.append(text[at : spans[first][0]])
        at = spans[i][1]
        i += 1
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, text: str, benchmark: DataFrame, item_id: str, item_text: str, size: int = SIZE, drop_share: float = 0.5, part_windows: int = PART_WINDOWS) -> DataFrame:
    """The documents without benchmark passages, all columns kept.

    Hit spans are cut out of a text; a document of whose words at least ``drop_share`` are hit is
    dropped whole. Documents without a hit, null and empty texts pass unchanged."""
    import pyarrow as pa

    table = Carried(docs)
    t, names = table.at(text), table.frame.columns

    def clean(b, found):
        keep, texts = [], []
        for x, hits in zip(column_list(b, t), found, strict=True):
            n = len(words_of(x.encode())) if hits else 0
            keep.append(not hits or int(hit_words(hits, n).sum()) < drop_share * n)
            texts.append(cut(x, hits) if hits and keep[-1] else x)
        columns = [pa.array(texts, b.column(x).type) if x == t else b.column(x) for x in names]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return table.back(scan(table.frame, t, benchmark, item_id, item_text, clean, table.frame.schema, size, part_windows))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

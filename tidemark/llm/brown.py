"""Class-based n-gram scores: P(w | before) = P(class(w) | class(before)) P(w | class(w)).

Classes are found by exchange, for every word of the training documents. The ``CLUSTERED`` most frequent words move one at a time,
each to the class that raises the likelihood of the class bigrams most, until none moves; all others are one class, the tail,
meanwhile. Then each word of the tail is exchanged in turn: by the counts of its own neighbours' classes over all
training documents it moves to the best of all classes, or stays. Words that no training document has belong to no
class: their probability is the sum over all classes of what each leaves for new words.

Texts are read once: words are numbered block by block, and a block's numbers and words are written as one row, so that no change
of partitioning can part them. Nothing that grows with the vocabulary is broadcast or collected. A word outside
the broadcast ones has at most one in ``CLUSTERED`` of all tokens, so no key of a shuffle is hot; what is
known of its neighbours is summed in a stream of sorted rows, never held as a group."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches_within, column_bytes, column_list, forget, lean, passing_shuffles, pick, written

CLASSES, CLUSTERED, ROUNDS = 60, 2000, 20
ADD, ADD_CLASS = 0.1, 0.1
#: Bytes of text whose words are numbered together.
BLOCK_BYTES = 8_000_000
MOST_COUNT = (1 << 16) - 1
#: A batch for Python ends here: blocks come one by one, and not all of a file's at once in each of several copies.
BATCH_BYTES = 1_000_000


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


class Classes:
    """Which class each code has. Codes: the frequent words in turn, the tail, the end. Classes: those of exchange, the tail, the end."""

    def __init__(self, moved: list[bytes], counts: list[int], classes: int = CLASSES):
        self.moved, self.counts = moved, np.array(counts, np.float64)
        self.classes, self.total = classes, classes + 2
        self.of_code = np.concatenate([np.arange(len(moved)) % classes, classes + np.arange(2)]).astype(np.int64)


def entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood of class bigrams by their counts, but for the words' own term."""
    return float(entropy(pairs).sum() - entropy(pairs.sum(axis=1)).sum() - entropy(pairs.sum(axis=0)).sum())


def class_pairs(state: Classes, pairs: np.ndarray) -> np.ndarray:
    """Class bigram counts of code bigram counts."""
    rows = np.zeros((state.total, pairs.shape[1]))
    np.add.at(rows, state.of_code, pairs)
    out = np.zeros((state.total, state.total))
    np.add.at(out.T, state.of_code, rows.T)
    return out


def exchange(state: Classes, pairs: np.ndarray) -> int:
    """One round: each frequent word in turn moves to its best class, all others as they then are. Returns how many moved.

    ``pairs`` has the counts of code bigrams. Gains are exact, so the likelihood never falls."""
    of, k, moved = state.of_code, state.classes, 0
    table = class_pairs(state, pairs)
    each = np.arange(k)
    for w in np.argsort(-state.counts, kind="stable").tolist():
        a, own = of[w], float(pairs[w, w])
        out = np.bincount(of, pairs[w], state.total)
        into = np.bincount(of, pairs[:, w], state.total)
        table[a, :] -= out
        table[:, a] -= into
        table[a, a] += own
        out[a] -= own
        into[a] -= own
        rows, columns, corner = table[:k], table[:, :k].T, table[each, each]
        f = entropy
        gain = (f(rows + out) - f(rows)).sum(axis=1) + (f(columns + into) - f(columns)).sum(axis=1)
        gain += f(corner + out[:k] + into[:k] + own) + f(corner) - f(corner + out[:k]) - f(corner + into[:k])
        left, right = rows.sum(axis=1) + into[:k], columns.sum(axis=1) + out[:k]
        gain -= f(left + out.sum() + own) - f(left) + f(right + into.sum() + own) - f(right)
        best = int(gain.argmax())
        if gain[best] <= gain[a] + 1e-9:
            best = a
        moved += best != a
        of[w] = best
        table[best, :] += out
        table[:, best] += into
        table[best, best] += own
    return moved


def packed(codes: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, of which the upper ones compress well."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def coded(plain: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of about ``block_bytes`` of text: the words, numbered; their counts ``ns`` in the block's training documents; and
    per document its id, whether it is held out, its length in words, and (all in ``codes``) its words' numbers. Written, so that
    blocks stay as they are."""
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        block, number, held, size = TaskContext.get().partitionId() << 32, defaultdict(count().__next__), [], 0

        def emit():
            of = {True: [], False: []}
            for _, out, codes in held:
                of[out].append(codes)
            ns = np.bincount(np.concatenate([*of[False], np.zeros(0, np.int64)]).astype(np.int64), minlength=len(number))
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
            words = pa.array(list(number), pa.binary()).cast(pa.string())
            codes = packed(np.concatenate([*(c for *_, c in held), np.zeros(0, np.uint32)]))
            columns = [pa.array([block], pa.int64()), one([i for i, *_ in held], kind_of_id), one([bool(h) for _, h, _ in held], pa.bool_()), one([len(c) for *_, c in held], pa.int32()), pa.array([codes], pa.binary()), one(words, None), one(ns, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "held", "lens", "codes", "words", "ns"])

        for b in batches:
            kind_of_id = b.schema.field(0).type
            for i, t, out in zip(column_list(b, "doc_id"), column_bytes(b, "text"), column_list(b, "held_out"), strict=True):
                words = tokens_of(t)
                held.append((i, bool(out), np.fromiter(map(number.__getitem__, words), np.uint32, len(words))))
                size += len(t or b"") + 100
                if size >= block_bytes:
                    yield emit()
                    block, number, held, size = block + 1, defaultdict(count().__next__), [], 0
        if held:
            yield emit()

    rows = plain.select("doc_id", "text", "held_out").mapInArrow(lean(run), f"block long, ids array<{kind}>, held array<boolean>, lens array<int>, codes binary, words array<string>, ns array<int>")
    return written(rows, "coded", **{"parquet.block.size": 4 * block_bytes})


def frequent(lexicon: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` words of the highest counts with theirs, the first by bytes of equal counts; a word must occur twice. Bounded."""
    words = lexicon.groupBy("word").agg(F.sum("n").alias("c")).where("c > 1")
    found = words.orderBy(F.desc("c"), "word").limit(most).collect()
    return sorted(((r["word"].encode(), r["c"]) for r in found), key=lambda x: (-x[1], x[0]))


def sequences(batch, code_of: dict[bytes, int], other: int, end: int) -> Iterator[tuple]:
    """Per block of the batch: its words, and of its training documents the words' numbers and codes in a row, each document between ends (numbered -1)."""
    import pyarrow as pa

    for k in range(batch.num_rows):
        words = batch.column(batch.schema.get_field_index("words"))[k].values
        lens = batch.column(batch.schema.get_field_index("lens"))[k].values.to_numpy()
        held = batch.column(batch.schema.get_field_index("held"))[k].values.to_numpy(zero_copy_only=False)
        numbers = unpacked(batch.column(batch.schema.get_field_index("codes"))[k].as_py())
        numbers = np.insert(numbers, np.cumsum(lens), -1)  # an end behind each document
        numbers = np.append(-1, numbers[np.repeat(~held, lens + 1)])
        codes = np.fromiter((code_of.get(w, other) for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words))
        yield words, numbers, np.append(codes, end)[numbers]


def code_pairs(blocks: DataFrame, state: Classes) -> np.ndarray:
    """How often each code follows each other one, over all training documents; a document starts after an end.

    Each task sums its own counts and hands on those that aren't zero; these are summed by key, at most codes x codes of
    them, which is the model's size and not the corpus's."""
    codes = len(state.of_code)
    sent = blocks.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(state.moved)})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros(codes * codes, np.int64)
        for b in batches:
            for _, _, c in sequences(b, sent.value, codes - 2, codes - 1):
                keys, n = np.unique(c[:-1] * codes + c[1:], return_counts=True)
                sums[keys] += n
        keys = np.nonzero(sums)[0]
        for at in range(0, len(keys), 100_000):
            some = keys[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["key", "n"])

    found = blocks.select("held", "lens", "codes", "words").mapInArrow(lean(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(codes * codes)
    sums[found.column("key").to_numpy()] = found.column("n").to_numpy()
    sent.unpersist()
    return sums.reshape(codes, codes)


def neighbours(blocks: DataFrame, state: Classes, most: int = MOST_COUNT) -> DataFrame:
    """Per block and word of the tail: ``beside``, how often which class stands behind it (key: the class) and before it
    (key: ``total`` and the class), in training documents. It holds 16-bit numbers: a key, its count, a key, its count; a greater count is
    several entries."""
    total, codes = state.total, len(state.of_code)
    sent = blocks.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(state.moved)}, state.of_code))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        code_of, of = sent.value
        for b in batches:
            for words, number, c in sequences(b, code_of, codes - 2, codes - 1):
                k = of[c]
                at = np.nonzero(c == codes - 2)[0]
                keys, n = np.unique(np.concatenate([number[at] * (2 * total) + k[at + 1], number[at] * (2 * total) + total + k[at - 1]]), return_counts=True)
                if len(n) and n.max() > most:
                    times = -(-n // most)
                    rest = n - (times - 1) * most
                    keys, n = np.repeat(keys, times), np.full(times.sum(), most)
                    n[np.cumsum(times) - 1] = rest
                ids, starts = np.unique(keys // (2 * total), return_index=True)
                entries = np.stack([keys % (2 * total), n], axis=1).astype("<u2")
                for i in range(0, len(ids), 20_000):
                    some = np.append(starts, len(keys))[i : i + 20_001]
                    data = entries[some[0] : some[-1]].tobytes()
                    beside = pa.BinaryArray.from_buffers(pa.binary(), len(some) - 1, [None, pa.py_buffer(((some - some[0]) * 4).astype(np.int32).tobytes()), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(ids[i : i + 20_000])), beside], names=["word", "beside"])

    return blocks.select("held", "lens", "codes", "words").mapInArrow(lean(run), "word string, beside binary")


def best_classes(row: np.ndarray, key: np.ndarray, n: np.ndarray, of: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The best class of each word, by class bigram counts as they are now; ``of``: the words' present classes.

    ``row``, ``key``, ``n``: the words' counts of neighbours, with keys as by ``neighbours``, each once. A word moves for a gain;
    of equal ones the first class has it. The last class, the end's, takes no words."""
    total, words = len(pairs), len(of)
    f, both = entropy, np.concatenate([pairs.T, pairs])  # by key: a count for each class
    combos, one = np.unique(key * (1 << 32) + np.minimum(n, (1 << 32) - 1).astype(np.int64), return_inverse=True)
    count = (combos & 0xFFFFFFFF).astype(np.float64)[:, None]
    up = f(both[combos >> 32] + count) - f(both[combos >> 32])
    gain = np.zeros((words, total))
    starts = np.nonzero(np.diff(row, prepend=-1))[0]
    gain[row[starts]] = np.add.reduceat(up[one.reshape(-1)], starts, axis=0)
    # a word's own class: what it has now against what would be left
    mine = both[key, of[row]]
    stay = np.bincount(row, f(mine) - f(np.maximum(mine - n, 0)), words)
    behind = key < total
    own = np.arange(words)
    for counts, sums in ((np.bincount(row[behind], n[behind], words), pairs.sum(axis=1)), (np.bincount(row[~behind], n[~behind], words), pairs.sum(axis=0))):
        kinds, which = np.unique(counts, return_inverse=True)
        gain -= (f(sums[None, :] + kinds[:, None]) - f(sums)[None, :])[which]
        stay -= f(sums[of]) - f(np.maximum(sums[of] - counts, 0))
    # all words would pick the same empty class at once, and be no wiser
    gain[:, (pairs.sum(axis=1) + pairs.sum(axis=0)) == 0] = -np.inf
    gain[:, -1] = -np.inf
    gain[own, of] = stay
    best = gain.argmax(axis=1)
    return np.where(gain[own, best] > stay + 1e-9, best, of)


def tail_classes(found: DataFrame, state: Classes, pairs: np.ndarray, together: int = 20_000) -> DataFrame:
    """Per word of the tail: its count ``c`` and best class ``k``. ``found``: word, beside, as by ``neighbours``.

    Rows come sorted by word and are summed as they come: of one word, however many rows it has, only its sums are held."""
    total = state.total
    sent = found.sparkSession.sparkContext.broadcast(pairs)
    rows = found.repartition("word").sortWithinPartitions("word")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def tables() -> Iterator:
            some, n = [], 0
            for b in batches:
                some.append(b)
                n += b.num_rows
                if n >= together:
                    yield pa.Table.from_batches(some).combine_chunks()
                    some, n = [], 0
            if some:
                yield pa.Table.from_batches(some).combine_chunks()

        def classed(words, row, key, n):
            k = best_classes(row, key, n, np.full(len(words), total - 2), sent.value)
            c = np.bincount(row[key < total], n[key < total], len(words)).astype(np.int64)
            return pa.RecordBatch.from_arrays([words, pa.array(c), pa.array(k, pa.int32())], names=["word", "c", "k"])

        last, last_cells, last_n = None, np.zeros(0, np.int64), np.zeros(0)
        for t in tables():
            words = t.column("word").combine_chunks()
            beside = t.column("beside").combine_chunks()
            cuts = np.frombuffer(beside.buffers()[1], np.int32)[beside.offset : beside.offset + len(beside) + 1].astype(np.int64) // 4
            entries = np.frombuffer(beside.buffers()[2], "<u2").reshape(-1, 2)[cuts[0] : cuts[-1]].astype(np.int64)
            lens = np.diff(cuts)
            first = np.append(True, pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)) if len(words) else np.zeros(0, bool)
            start = np.nonzero(first)[0]
            row = np.repeat(np.cumsum(first) - 1, lens)
            cells, n = row * (2 * total) + entries[:, 0], entries[:, 1].astype(np.float64)
            names = words.take(pa.array(start))
            if last is not None:
                if last.as_py() == names[0].as_py():
                    cells, n = np.concatenate([last_cells, cells]), np.concatenate([last_n, n])
                else:
                    cells, n = np.concatenate([last_cells, cells + 2 * total]), np.concatenate([last_n, n])
                    names = pa.concat_arrays([pa.array([last.as_py()], names.type), names])
            cells, where = np.unique(cells, return_inverse=True)
            n = np.bincount(where.reshape(-1), n, len(cells))
            row, key = cells // (2 * total), cells % (2 * total)
            done = row < len(names) - 1
            if len(names) > 1:
                yield classed(names[:-1], row[done], key[done], n[done])
            last, last_cells, last_n = names[-1], key[~done], n[~done]
        if last is not None:
            yield classed(pa.array([last.as_py()], pa.string()), np.zeros(len(last_cells), np.int64), last_cells, last_n)

    return rows.mapInArrow(lean(run), "word string, c long, k int")


def classed_documents(blocks: DataFrame, classes: DataFrame, lexicon: DataFrame, unseen: int, n: int, v: int, ends_learned: int) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, base_score, ``own`` (the sum over known words of log10(c + ADD)), and
    ``ks``, a byte per word, its class (``unseen``: none)."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    base = float(np.log10(n + ADD * (v + 1)))
    known = lexicon.select("block", "at", "word").join(classes, "word").select(F.col("block").alias("b"), "at", "c", "k")

    def run(left, right):
        import pyarrow as pa

        numbers = unpacked(left.column("codes")[0].as_py())
        lens = left.column("lens")[0].values.to_numpy()
        size = int(numbers.max()) + 1 if len(numbers) else 0
        at = right.column("at").to_numpy()
        c_of, k_of = np.zeros(size), np.full(size, unseen, np.uint8)
        c_of[at], k_of[at] = right.column("c").to_numpy(), right.column("k").to_numpy()
        ends = np.cumsum(lens)
        doc = np.repeat(np.arange(len(lens)), lens)
        there, own = (c_of > 0)[numbers], np.log10(c_of + ADD)[numbers]
        n_known = np.bincount(doc, there, len(lens)).astype(np.int64)
        plain = np.bincount(doc, own, len(lens)).astype(np.float64) + np.log10(ends_learned + ADD)
        ks = k_of[numbers].tobytes()
        return pa.table({
            "doc_id": left.column("ids")[0].values, "held_out": left.column("held")[0].values, "n_tokens": pa.array(lens + 1, pa.int64()), "n_known": n_known + (ends_learned > 0),
            "base_score": plain - base * (lens + 1), "own": np.bincount(doc, own * there, len(lens)).astype(np.float64), "ks": pa.array([ks[e - m : e] for e, m in zip(ends.tolist(), lens.tolist(), strict=True)], pa.binary()),
        })

    rows = blocks.select("block", "ids", "held", "lens", "codes")
    return rows.groupBy("block").cogroup(known.groupBy("b")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, own double, ks binary")


def class_bigrams(documents: DataFrame, total: int) -> np.ndarray:
    """Counts of class bigrams in the documents (column ``ks``), each between two ends (class ``total`` - 1)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums = np.zeros(total * total, np.int64)
        for b in batches:
            k = chained(column_list(b, "ks"), total - 1)
            sums += np.bincount(k[:-1] * total + k[1:], minlength=total * total)
        keys = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums[keys])], names=["key", "n"])

    sums = np.zeros(total * total)
    for key, n in documents.select("ks").mapInArrow(lean(run), "key long, n long").groupBy("key").agg(F.sum("n")).collect():  # classes squared at most
        sums[key] = n
    return sums.reshape(total, total)


def chained(ks: list[bytes], end: int) -> np.ndarray:
    """The documents' classes in a row, an end before each and behind the last."""
    mark = bytes([end])
    return np.frombuffer(mark + b"".join(x + mark for x in ks), np.uint8).astype(np.int64)


def log_steps(pairs: np.ndarray, size: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """By class before and class: log10 of what the step contributes to a text's probability, but for a known word's own log10(c + ADD).

    One more row and column than classes: those of words without a class. What follows such a word is as after any; such a
    word itself is what each class leaves for new words, over all classes."""
    total = len(pairs)
    before = np.vstack([pairs, pairs.sum(axis=0)]) + ADD_CLASS
    step = before / before.sum(axis=1, keepdims=True)
    room = size + ADD * (kinds + 1)
    room[-1] = 1  # an end's class has nothing but ends
    new = step[:, :-1] @ (ADD / room[:-1])
    return np.log10(np.hstack([step / room, new[:, None]])).reshape(total + 1, total + 1)


def scores(docs: DataFrame, doc_id: str, text: str, held_out: Column, classes: int = CLASSES, clustered: int = CLUSTERED, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``score`` is the class model's log10 probability of the text and its end, ``base_score`` that of smoothed word
    frequencies, ``perplexity`` 10 to the -score / n_tokens. Learns from the rows that are not held out. A null text is empty:
    its end is its one token. With nothing to learn from, all classes are equally likely and every word is new to each.
    Words of equal counts are taken by their bytes; of classes of equal gain the first is. Repeated rows stay
    repeated, with the same scores. An empty table gives an empty one."""
    plain = pick(docs, doc_id, text).toDF("doc_id", "text").withColumn("held_out", held_out)
    with batches_within(docs.sparkSession, BATCH_BYTES):
        kept, steps, n = _learned(plain, classes, clustered, rounds, block_bytes)
    return _scored(kept, steps, n)


def _learned(plain: DataFrame, classes: int, clustered: int, rounds: int, block_bytes: int) -> tuple[DataFrame, np.ndarray, int]:
    """The documents by their classes, written; the class model's steps; how many tokens it learned from."""
    spark = plain.sparkSession
    blocks = coded(plain, block_bytes)
    learned = F.zip_with("held", "lens", lambda h, n: F.when(h, F.struct(F.lit(0).alias("d"), F.lit(0).cast("long").alias("n"))).otherwise(F.struct(F.lit(1).alias("d"), (n + 1).cast("long").alias("n"))))
    sums = blocks.select(F.explode(learned).alias("x")).agg(F.sum("x.d"), F.sum("x.n")).first()
    ends, n = int(sums[0] or 0), int(sums[1] or 0)
    lexicon = blocks.select("block", "ns", F.posexplode("words").alias("at", "word")).withColumn("n", F.get("ns", F.col("at")))
    with passing_shuffles(spark):
        words = frequent(lexicon, clustered)
    state = Classes([w for w, _ in words], [c for _, c in words], classes)
    counts = code_pairs(blocks, state)
    for _ in range(rounds):
        if not exchange(state, counts):
            break
    tail = tail_classes(neighbours(blocks, state), state, class_pairs(state, counts))
    first = spark.createDataFrame([(w.decode(), c, int(k)) for (w, c), k in zip(words, state.of_code, strict=False)], "word string, c long, k int")
    found = written(tail.unionByName(first), "classes")
    size, kinds = np.zeros(state.total), np.zeros(state.total)
    for r in found.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        size[r["k"]], kinds[r["k"]] = r["c"], r["n"]
    v = int(kinds.sum()) + (ends > 0)
    kept = written(classed_documents(blocks, found, lexicon, state.total, n, v, ends), "classed-documents")
    forget(blocks)
    forget(found)
    steps = log_steps(class_bigrams(kept.where(~F.col("held_out")), state.total), size, kinds)
    return kept, steps, n


def _scored(kept: DataFrame, steps: np.ndarray, n: int) -> DataFrame:
    sent, end = kept.sparkSession.sparkContext.broadcast(steps), len(steps) - 2
    kind = kept.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            k = chained(column_list(b, "ks"), end)
            length = b.column(b.schema.get_field_index("n_tokens")).to_numpy()
            score = np.add.reduceat(sent.value[k[:-1], k[1:]], np.cumsum(length) - length) + b.column(b.schema.get_field_index("own")).to_numpy()
            columns = [b.column(b.schema.get_field_index(x)) for x in names[:4]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(length), n, np.int64)), b.column(b.schema.get_field_index("base_score")), pa.array(score), pa.array(10 ** (-score / length))], names=names)

    return kept.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")

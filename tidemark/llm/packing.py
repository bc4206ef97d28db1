"""Packing in order: windows are cut by dynamic programming, at document or sentence boundaries.

Documents keep their order. Over the boundaries of a run of token ids, best[k] is the least cost of windows that end at
boundary k: best[k] = cut(k) + min over i with c_k - c_i <= window of best[i] + window - (c_k - c_i), where
cut(k) is nothing at a document's end, ``sentence`` at a sentence's and ``hard`` elsewhere (other places
count only inside sentences longer than a window). The minimum is over a sliding window of best[i] + c_i and comes from a
monotone queue, so each boundary costs constant time."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytepairs import word_encoder
from tidemark.llm.common import column_list, lean, pick

WINDOW, END = 4096, 2
SENTENCE, HARD = 4, 64
#: Tokens that are cut into windows together, and bytes of text that a task packs.
RUN_TOKENS, TASK_BYTES = 2_000_000, 16_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def sentence_ends(encoder) -> np.ndarray:
    """For each id whether its token ends a sentence: marks of the kind . ! ? and nothing but marks."""
    table = np.zeros(1 << 17, bool)
    for token, i in encoder.merges.vocab.items():
        bare = token.removesuffix(encoder.merges.end)
        if bare and token != bare and bare[0] in ".!?" and not any(c.isalnum() for c in bare):
            table[i] = True
    return table


def cuts(ends: np.ndarray, sentences: np.ndarray, window: int = WINDOW, sentence: float = SENTENCE, hard: float = HARD) -> np.ndarray:
    """Where to cut: positions from 0 to the total, windows of at most ``window`` between them, at the least cost.

    ``ends``: positions at which documents end, the total last; ``sentences``: those at which sentences do."""
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return np.zeros(1, np.int64)
    price = np.full(total + 1, np.inf, np.float32)  # of a cut at each place; places without one are no boundaries
    price[sentences[(sentences >= 0) & (sentences <= total)]] = sentence
    price[ends] = 0
    price[0] = 0
    places = np.nonzero(price < np.inf)[0]
    gaps = np.nonzero(np.diff(places) > window)[0]
    for g in gaps.tolist():
        price[places[g] + 1 : places[g + 1]] = hard
    if len(gaps):
        places = np.nonzero(price < np.inf)[0]
    cost = price[places]
    place, cost = places.tolist(), cost.tolist()
    best, back = [0.0] * len(place), [0] * len(place)
    queue: deque = deque([(0.0, 0)])  # (best + place, index), values rising
    for k in range(1, len(place)):
        c = place[k]
        while place[queue[0][1]] < c - window:
            queue.popleft()
        value, i = queue[0]
        best[k], back[k] = cost[k] + value + window - c, i
        value = best[k] + c
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, k))
    at, out = len(place) - 1, []
    while at:
        out.append(place[at])
        at = back[at]
    return np.array([0, *reversed(out)], np.int64)


def pieces(ids: list[np.ndarray], ends_sentence: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, start, length, crc32 of the ids, window, offset in it) of each piece of the documents' ids, in order."""
    ends = np.cumsum([len(x) for x in ids])
    every = np.concatenate(ids)
    where = cuts(ends, np.nonzero(ends_sentence[every])[0] + 1, window)
    mark = np.zeros(len(every) + 1, bool)
    mark[where] = mark[ends] = True
    marks = np.nonzero(mark[1:])[0] + 1
    starts = np.concatenate([[0], marks[:-1]])
    raw = every.astype("<u4").tobytes()
    for a, b, w, d in zip(starts.tolist(), marks.tolist(), (np.searchsorted(where, starts, "right") - 1).tolist(), np.searchsorted(ends, starts, "right").tolist(), strict=True):
        first = int(ends[d - 1]) if d else 0
        yield d, a - first, b - a, zlib.crc32(raw[4 * a : 4 * b]), w, a - int(where[w])


def pack(docs: DataFrame, doc_id: str, text: str, window: int = WINDOW, end: int = END, path: str | None = None, task_bytes: int = TASK_BYTES, run_tokens: int = RUN_TOKENS) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The order is that of the ids, nulls first, and of the texts' hashes where ids are alike. Tasks hold ranges of it of
    about ``task_bytes`` of text and cut them in runs of about ``run_tokens`` ids, so that many copies of one row
    (which a range cannot part) still take bounded memory. A null text is empty: one piece,
    the end id. An empty table gives an empty one. A sequence's id holds the task's number and a
    count, so a task that runs again gives the same."""
    import pyarrow as pa

    where = path or default_path()
    plain = pick(docs, doc_id, text).toDF("doc_id", "text")
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // task_bytes))
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = plain.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = plain.schema["doc_id"]
    schema = f"doc_id {kind.dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        encoder = word_encoder(where)
        ends_sentence = sentence_ends(encoder)
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        names, held, n = [], [], 0

        def flush():
            nonlocal sequence, names, held, n
            rows = list(pieces(held, ends_sentence, window))
            table = np.array(rows, np.int64).reshape(-1, 6)
            lengths = np.array([len(x) for x in held], np.int64)
            d = table[:, 0]
            out = pa.RecordBatch.from_arrays([pa.array([names[i] for i in d.tolist()], pa_kind), *(pa.array(np.ascontiguousarray(x)) for x in (table[:, 1], table[:, 2], table[:, 3], lengths[d], table[:, 4] + sequence, table[:, 5]))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            sequence += int(table[:, 4].max()) + 1
            names, held, n = [], [], 0
            return out

        pa_kind = None
        for b in batches:
            pa_kind = b.schema.field(0).type
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                for i, ids in zip(column_list(some, "doc_id"), encoder.encode_many([t or "" for t in column_list(some, "text")]), strict=True):
                    names.append(i)
                    held.append(np.append(ids, np.uint32(end)))
                    n += len(held[-1])
                    if n >= run_tokens:
                        yield flush()
        if held:
            yield flush()

    return ordered.mapInArrow(lean(run), schema)

"""Token counts from a table of exact counts at every prefix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytepairs import prefix_counter
from tidemark.llm.common import column_list, lean, pick


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def longest_within(counts: np.ndarray, budget: int) -> int:
    """The length of the longest prefix of at most ``budget`` tokens (a longer prefix may have fewer tokens)."""
    return int(np.nonzero(counts <= budget)[0][-1])


def with_prefix_counts(docs: DataFrame, doc_id: str, text: str, path: str | None = None) -> DataFrame:
    """Per row: doc_id, and ``prefix_tokens``, an array whose element i is the exact token count of the first i code points.

    Null and empty texts have the array [0]. Questions are then answered without encoding again:
    ``tokens_at`` and ``fitting_prefix``."""
    import pyarrow as pa

    where = path or default_path()
    plain = pick(docs, doc_id, text).toDF("doc_id", "text")
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        counter = prefix_counter(where)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                few = b.slice(at, 64)
                tables = [counter.prefixes(t or "").astype(np.int32) for t in column_list(few, "text")]
                ends = np.cumsum([0, *map(len, tables)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tables)))
                yield pa.RecordBatch.from_arrays([few.column(0), lists], names=["doc_id", "prefix_tokens"])

    return plain.mapInArrow(lean(run), f"doc_id {kind}, prefix_tokens array<int>")


def tokens_at(prefix_tokens: str, length: Column) -> Column:
    """The token count of the first ``length`` code points; of the whole text if that is shorter."""
    return F.get(F.col(prefix_tokens), F.least(length.cast("int"), F.size(prefix_tokens) - 1))


def fitting_prefix(prefix_tokens: str, budget: int) -> Column:
    """The length in code points of the longest prefix of at most ``budget`` tokens."""
    return F.array_max(F.filter(F.transform(F.col(prefix_tokens), lambda n, i: F.when(n <= budget, i)), lambda i: i.isNotNull()))


def count(docs: DataFrame, doc_id: str, text: str, limit: int = 1024, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit, and fitting_chars: the longest prefix (code points) of at most ``limit`` tokens.

    All come from prefix counts: a text's from those of its pretokens, which are worked out once and kept, up to
    a bound. A null text counts as an empty one. Repeated rows stay repeated. An empty table gives an empty one."""
    import pyarrow as pa

    where = path or default_path()
    plain = pick(docs, doc_id, text).toDF("doc_id", "text")
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        counter = prefix_counter(where)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                texts = [t or "" for t in column_list(some, "text")]
                n = np.array(counter.counts(texts), np.int64)
                size = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
                fit = np.fromiter((len(t) if k <= limit else fitting(counter, t, limit) for t, k in zip(texts, n.tolist(), strict=True)), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(size), pa.array(n), pa.array(n > limit), pa.array(fit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"])

    return plain.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long")


def fitting(counter, text: str, limit: int) -> int:
    """``longest_within`` of the whole text, from the prefix counts of the stretch that the limit falls in."""
    cuts, totals = counter.boundaries(text)
    # prefixes that end in unit k have between totals[k] and, at most, a token per byte of the unit more
    last = int(np.nonzero(totals <= limit)[0][-1])
    end = cuts[last + 1] if last + 1 < len(cuts) else len(text)
    table = counter.prefixes(text[cuts[last] : end]) + totals[last]
    return int(cuts[last]) + longest_within(table, limit)

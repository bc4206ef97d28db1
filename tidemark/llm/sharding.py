"""Shards that all have the corpus's mixture: proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; by fractional rank (rank less a half, over
the source's rows) all sources interleave in proportion; the interleaved order is cut into shards whose
row counts differ by one at most. Ranks come from counts: a row's rank is its rank among the rows
that share a short prefix of the hash, plus the counts of the prefixes before. So no source,
however hot, is sorted in one task, and texts are never shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick, written

#: Rows that share a source and a hash prefix, or a stretch of the interleaved order, about as many as a task sorts at once.
BIN_ROWS = 20_000


def shards(docs: DataFrame, doc_id: str, text: str, source: str, count: int = 8, seed: str = "shard", bin_rows: int = BIN_ROWS) -> DataFrame:
    """Per row: doc_id, size (UTF-8 bytes and one), text_crc32, law ('rows'), shard, slot (from 0 in its shard), grown_shard (null), source.

    A null text has size 1 and the crc32 of nothing. A null source is a source of its own. Rows alike
    in id and text tie and are interchangeable: which of them comes first doesn't show. An empty table
    gives an empty one."""
    rows = pick(docs, doc_id, text, source).toDF("doc_id", "text", "source")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = rows.select("doc_id", "source", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    keyed = written(keyed.withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.col("size").cast("string")).cast("binary"))), "sharding-keys")
    # bins by the hash's first digits, as many as keep one at about bin_rows if a single source had all rows
    total = keyed.count()
    digits = 1
    while digits < 12 and total > bin_rows * 16**digits:
        digits += 1
    keyed = keyed.withColumn("bin", F.substring("h", 1, digits))
    bins = keyed.groupBy("source", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("of", F.sum("n").over(Window.partitionBy("source")))
    within = Window.partitionBy("source", "bin").orderBy("h", "doc_id")
    ranked = keyed.withColumn("r", F.row_number().over(within))
    ranked = ranked.join(bins.select(F.col("source").alias("s"), F.col("bin").alias("b"), "before", "of"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).drop("s", "b", "bin")
    ranked = ranked.withColumn("place", (F.col("r") + F.col("before") - F.lit(0.5)) / F.col("of"))
    stretches = max(1, -(-total // bin_rows))
    ranked = written(ranked.select("doc_id", "source", "size", "text_crc32", "h", "place", F.floor(F.col("place") * stretches).cast("long").alias("stretch")), "sharding-ranks")
    # the interleaved order, by the same counting over stretches of fractional rank
    counts = ranked.groupBy("stretch").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    order = Window.partitionBy("stretch").orderBy("place", F.col("source").asc_nulls_first(), "h", "doc_id")
    placed = ranked.withColumn("r", F.row_number().over(order)).join(counts, "stretch").withColumn("at", F.col("r") + F.col("before") - 1)
    shard = F.expr(f"(at * {count}L) div {max(total, 1)}L")
    # shard k begins at the least position p with p * count >= k * total
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("at") - F.expr(f"(shard * {max(total, 1)}L + {count - 1}L) div {count}L")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def write_shards(docs: DataFrame, placed: DataFrame, doc_id: str, path: str) -> None:
    """The documents as Parquet, one folder a shard, in the order of their slots. Ids must be unique here."""
    spots = placed.select(F.col("doc_id").alias("_id"), "shard", "slot")
    joined = docs.join(spots, docs[doc_id] == spots["_id"]).drop("_id")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

"""The queries of this subpackage, under production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import brown, decontaminate, language, packing, pii, quality, secrets, sharding, simhash, token_counts
from tidemark.llm.common import documents, fold


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, "doc_id", "text", "lang", held_out=fold(F.col("doc_id"), 4) == 2)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir), "doc_id", "text")


def op3_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.scores(documents(spark, sf_dir), "doc_id", "text", held_out=fold(F.col("doc_id"), 10) == 0)


#: Stands for a secret that a real run takes from its own store.
PII_KEY = "tidemark-surrogates"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.protect(documents(spark, sf_dir), "doc_id", "text", key=PII_KEY)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), "doc_id", "text", "source")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir), "doc_id", "text", "source", count=8)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), "doc_id", "text", window=4096, end=2)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(documents(spark, sf_dir), "doc_id", "text", shingle=4, radius=4)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.report(documents(spark, sf_dir), "doc_id", "text", benchmark, "item_id", "text", size=10).drop("items")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(documents(spark, sf_dir), "doc_id", "text", limit=1024)


def secrets_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2_secrets: the counts of its base kinds."""
    return op2_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def brown_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3_brown: all but the class model's score."""
    return op3_brown(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6_sharding: how many rows each shard has, and that its slots have no gap."""
    return op6_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("first"), F.max("slot").alias("last"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: crc32 of the id as text, by its definition: a reduction of its bytes, eight steps each.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(list_filter(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: x <> ''), lambda x: CAST(ascii(x) AS BIGINT))),
 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, (x % 2) * 3988292384))), 4294967295)"""
ORACLES = {
    "secrets_counts": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '({_ANY_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex FROM d""",
    "brown_base": rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_CRC} % 10 = 0 AS held_out, list_append({_WORDS}, '') AS w FROM documents),
t AS (SELECT rid, held_out, unnest(w) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word),
s AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c),
x AS (SELECT rid, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.1e0) / (n + 0.1e0 * (v + 1)))) AS base FROM t LEFT JOIN c USING (word), s GROUP BY rid)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(base, 4) AS base_score FROM d JOIN x USING (rid), s""",
    "shard_sizes": """WITH n AS (SELECT count(*) AS n FROM documents), p AS (SELECT unnest(range(n)) AS p, n FROM n)
SELECT CAST((p * 8) // n AS INTEGER) AS shard, count(*) AS n, count(*) AS slots, 0::BIGINT AS first, count(*) - 1 AS last FROM p GROUP BY 1""",
}


def queries() -> dict:
    found = (op1_language, op2_secrets, op3_brown, op4_pii, op5_quality, op6_sharding, op7_packing, op8_simhash, op9_decontaminate, op10_token_counts, secrets_counts, brown_base, shard_sizes)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality": quality.ORACLE, "op9_decontaminate": decontaminate.ORACLE, **ORACLES}

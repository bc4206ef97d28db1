"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

1. quality: documents that fail the quality rules, as strictly as their host's record has them applied, go.
2. simhash: of each near-duplicate class one document stays.
3. decontaminate: benchmark passages are cut out; documents that are mostly such a passage go.
4. pii: personal data is replaced by surrogates.
5. packing: what is left is cut into sequences.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, packing, pii, quality, simhash
from tidemark.llm.common import documents, forget, short_batches, written

#: The surrogates' key; a real run sets its own.
PII_KEY = os.environ.get("TIDEMARK_PII_KEY", "tidemark-surrogates")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, "text", "source")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return simhash.keep_first(docs, "doc_id", "text", shingle=5, similarity=0.8)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, "text", benchmark, "item_id", "text", size=10)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_in(docs, "text", key=PII_KEY)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return packing.pack(docs, "doc_id", "text", window=4096, end=2)


STAGES = [("quality", quality_stage), ("simhash", simhash_stage), ("decontaminate", decontaminate_stage), ("pii", pii_stage), ("packing", packing_stage)]
#: SimHash classes and tokenizers are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written to the shared folder and read again."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:  # what the stage read is written anew by now
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

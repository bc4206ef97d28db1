"""Manuals: an index of chunks, and facts taken from them with citations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.semantics import salvage
from tidemark.sources import layout


def load_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text) of the text files under a path."""
    from pyspark.sql import functions as F

    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("doc"), F.col("value").alias("text"))


def index(docs: DataFrame, path: str | None = None, size: int = 800) -> DataFrame:
    """Chunks of documents; kept as Parquet if a path is given."""
    made = layout.chunks(docs, "doc", "text", size)
    if path:
        made.write.mode("overwrite").parquet(path)
        made = docs.sparkSession.read.parquet(path)
    return made


def noise(fact: str) -> bool:
    """Whether a fact says too little to keep: too short, no words, or about the document itself."""
    words = re.findall(r"[A-Za-z]{2,}", fact)
    return len(words) < 4 or bool(re.search(r"\b(?:table of contents|copyright|all rights reserved|page \d+|this (?:document|manual|chapter))\b", fact, re.I))


def extract_facts(chunked: DataFrame, provider, most: int = 40) -> list[dict]:
    """Facts a model finds in evenly chosen chunks, each with its document and page; repeats and noise left out."""
    n = chunked.count()
    rows = chunked.orderBy("doc", "page").collect() if n <= most else [r for i, r in enumerate(chunked.orderBy("doc", "page").toLocalIterator()) if i * most // n != (i - 1) * most // n]
    seen, out = set(), []
    for r in rows:
        for found in salvage(provider.complete("Facts as JSON objects with a key fact.", r["text"])):
            fact = str(found.get("fact") or "").strip()
            key = re.sub(r"[^a-z0-9]+", " ", fact.lower()).strip()
            if key and key not in seen and not noise(fact):
                seen.add(key)
                out.append({"fact": fact, "citation": f"{r['doc']} p. {r['page']}"})
    return out

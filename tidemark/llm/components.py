"""Connected components of a graph that may be larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import with_least, written


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Of each node with an edge, the smallest node it is connected to: columns ``node``, ``root``.

    Large-star and small-star rounds in turn: every round points each node at the smallest
    neighbour, keeps connectivity and never holds a node's neighbours in one place: minima are
    taken, and joined to the edges, by node and salt.
    Each round is written to the shared folder. Nulls and loops are no edges; repeated edges count
    once; an empty table gives an empty one."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = written(e, "edges")
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above a node point at the least of it and its neighbours
        large = with_least(both, "u", "v", "m").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        # small star: a node's lower neighbours, and itself, point at the least of them
        small = with_least(large, "u", "v", "m")
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        e = written(small.select(F.inline(pairs)).where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    root = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())

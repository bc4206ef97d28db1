"""Neighbours and running sums along time without gathering all rows in one task.

Rows are windowed within stretches of time; what crosses from one stretch to the next comes from a
table with one row a stretch. The result is that of a window over everything, exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400.0


def stretched(df: DataFrame, time: str, width: float = DAY) -> DataFrame:
    return df.withColumn("_stretch", F.floor(F.col(time) / F.lit(float(width))).cast("long"))


def with_neighbour(df: DataFrame, time: str, columns: list[str], by: list[str] | None = None, tie: list[str] | None = None, width: float = DAY, after: bool = False, prefix: str = "prev_") -> DataFrame:
    """The table with ``prev_<column>`` for each column: its value in the row before (or after) by time within ``by``.

    Rows without a time are dropped. ``tie`` orders rows of one time; the first row's values are null."""
    by, tie = by or [], tie or []
    rows = stretched(df.where(F.col(time).isNotNull()), time, width)
    order = [F.col(time), *[F.col(c) for c in tie]]
    key = F.struct(time, *tie)
    within = Window.partitionBy(*by, "_stretch").orderBy(*order)
    step = F.lead if after else F.lag
    values = F.struct(*[F.col(c).alias(c) for c in columns])
    rows = rows.withColumn("_near", step(values).over(within))
    edge = rows.groupBy(*by, "_stretch").agg((F.min_by if after else F.max_by)(values, key).alias("_edge"))
    across = Window.partitionBy(*by).orderBy("_stretch") if by else Window.partitionBy(F.lit(0)).orderBy("_stretch")
    edge = edge.withColumn("_edge", step("_edge").over(across))
    joined = rows.join(edge.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_stretch").alias("_s"), "_edge"), [*[F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)], F.col("_stretch") == F.col("_s")], "left")
    near = F.coalesce("_near", "_edge")
    for c in columns:
        joined = joined.withColumn(f"{prefix}{c}", near[c])
    return joined.drop("_near", "_edge", "_s", *[f"_b{i}" for i in range(len(by))])


def with_running_sum(df: DataFrame, time: str, value: Column, out: str, by: list[str] | None = None, tie: list[str] | None = None, width: float = DAY) -> DataFrame:
    """The table with the sum of ``value`` up to and including each row, by time within ``by``."""
    by, tie = by or [], tie or []
    rows = stretched(df.where(F.col(time).isNotNull()).drop("_stretch"), time, width).withColumn("_v", F.coalesce(value, F.lit(0.0)))
    within = Window.partitionBy(*by, "_stretch").orderBy(time, *tie).rowsBetween(Window.unboundedPreceding, 0)
    total = rows.groupBy(*by, "_stretch").agg(F.sum("_v").alias("_t"))
    across = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumn("_t", F.coalesce(F.sum("_t").over(across), F.lit(0.0)))
    joined = rows.withColumn("_w", F.sum("_v").over(within)).join(total.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_stretch").alias("_s"), "_t"), [*[F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)], F.col("_stretch") == F.col("_s")])
    return joined.withColumn(out, F.col("_w") + F.col("_t")).drop("_v", "_w", "_t", "_s", "_stretch", *[f"_b{i}" for i in range(len(by))])


def numbered(df: DataFrame, order: list[str], out: str, bins: int = 256) -> DataFrame:
    """The table with each row's place, from 1, in the order of the columns; the first of them must be numeric.

    Places are counted by ranges of the first column, whose bounds are approximate quantiles."""
    first = order[0]
    cuts = sorted(set(df.stat.approxQuantile(first, [i / bins for i in range(1, bins)], 0.5 / bins)))
    bound = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    rows = df.withColumn("_bin", F.size(F.filter(bound, lambda c: c < F.col(first))))
    counts = rows.groupBy("_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_bin").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy("_bin").orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(within)).join(counts, F.col("_bin") == F.col("_b")).withColumn(out, (F.col("_r") + F.col("_o")).cast("long")).drop("_bin", "_b", "_o", "_r")

"""Exact order statistics of a column of any size, without holding its values in one task.

Approximate quantiles bracket the rank that is sought; rows outside the bracket are counted and left out, until what is left is few enough to be
ranked by distinct value. The result is that of sorting everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows from which on a column is bracketed before it is ranked.
MOST, ACCURACY = 1_000_000, 10_000


def order_statistic(rows: DataFrame, column: str, rank: int, n: int, most: int = MOST):
    """The value at a rank (from 0) of the ``n`` values in order; ``rows`` has no nulls in the column."""
    x, reach = F.col(column), 3.0 / ACCURACY
    while n > most:
        q = rank / max(n - 1, 1)
        lo, hi = rows.agg(F.percentile_approx(x, [max(0.0, q - reach), min(1.0, q + reach)], ACCURACY)).first()[0]
        below, within = rows.agg(F.count_if(x < lo), F.count_if((x >= lo) & (x <= hi))).first()
        if not below <= rank < below + within:
            reach *= 4
            continue
        if lo == hi:
            return lo
        if within == n:
            break
        rows, rank, n = rows.where((x >= lo) & (x <= hi)), rank - below, within
    counts = rows.groupBy(x.alias("_x")).agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_c", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_x")))
    return upto.where(F.col("_c") > rank).agg(F.min("_x")).first()[0]


def exact_quantile(df: DataFrame, column: str, q: float, most: int = MOST) -> tuple[float | None, int]:
    """(the quantile, the number of values) of a column's values that aren't null, between neighbours in proportion; None of no values."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    n = rows.count()
    if not n:
        return None, 0
    if n <= most:
        return rows.agg(F.percentile("x", q)).first()[0], n
    place = q * (n - 1)
    low = order_statistic(rows, "x", int(place), n, most)
    if place == int(place):
        return low, n
    return low + (order_statistic(rows, "x", int(place) + 1, n, most) - low) * (place - int(place)), n


def upper_median(df: DataFrame, column: str, most: int = MOST) -> tuple[float | None, int]:
    """(the element at n // 2, from 0, of the values in order; n); None of no values."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    n = rows.count()
    return (order_statistic(rows, "x", n // 2, n, most) if n else None), n

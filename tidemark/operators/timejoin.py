"""Joins in time: grids, backward as-of within a tolerance, nearest, ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import quoted, tick
from tidemark.operators.aggregates import widest_columns


def first_per_tick(df: DataFrame, columns: list[str], hz: float = 10.0, time: str = "timestamp", tag: str = "") -> DataFrame:
    """One row per grid tick ``tg``, the earliest (ties by the columns' values), its columns renamed ``<tag>__<column>`` if a tag is given."""
    name = (lambda c: f"{tag.replace('-', '_')}__{c}") if tag else (lambda c: c)
    values = F.struct(*[quoted(c).alias(name(c)) for c in columns])
    rows = df.where(F.col(time).isNotNull()).select(tick(F.col(time), hz).alias("tg"), values.alias("v"), F.col(time).alias("t"))
    return rows.groupBy("tg").agg(F.min_by("v", F.struct("t", "v")).alias("v")).select("tg", "v.*")


def fuse(sources: dict[str, DataFrame], hz: float = 10.0, time: str = "timestamp", most: int = 10, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """The sources' widest-varying columns side by side, at the ticks that all of them have.

    Every source is reduced to one row per tick before the join, so no tick multiplies rows."""
    picked = {s: (columns or {}).get(s) or widest_columns(df, most, time) for s, df in sources.items()}
    usable = {s: c for s, c in picked.items() if c}
    if len(usable) < 2:
        raise ValueError("fusion needs two sources with columns that vary")
    return reduce(lambda a, b: a.join(b, "tg"), [first_per_tick(sources[s], c, hz, time, s) for s, c in usable.items()])


def asof(left: DataFrame, right: DataFrame, time: str, columns: list[str], tolerance: float, by: list[str] | None = None) -> DataFrame:
    """The left rows with the right's ``columns`` as of the last right row at or before them, within the tolerance; others go.

    Look-back is bounded, so the last right row lies in the left row's stretch of ``tolerance`` seconds or the one before:
    an equi-join on stretches finds it. Right rows are cut to what a stretch needs by ordering them with the left rows there:
    the two are unioned and the last right value is carried forward, so a stretch costs its own rows and not their product.
    A left column that clashes with one of ``columns`` should be renamed first; right ties are broken by the columns."""
    by, w = by or [], float(tolerance) if tolerance > 0 else 1.0
    stretch = lambda t: F.floor(t / F.lit(w)).cast("long")
    kept = left.columns
    a = left.where(F.col(time).isNotNull()).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], stretch(F.col(time)).alias("_s"), F.col(time).cast("double").alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in kept]).alias("_l"), F.lit(None).cast(_struct(right, time, columns)).alias("_r"))
    value = F.struct(F.col(time).cast("double").alias("_rt"), *[F.col(c) for c in columns])
    r = right.where(F.col(time).isNotNull()).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.explode(F.array(stretch(F.col(time)), stretch(F.col(time)) + 1)).alias("_s"), F.col(time).cast("double").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(_struct_of(left)).alias("_l"), value.alias("_r"))
    order = Window.partitionBy(*[f"_by{i}" for i in range(len(by))], "_s").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(r).withColumn("_r", F.last("_r", ignorenulls=True).over(order)).where("_side = 1")
    found = carried.where(F.col("_r").isNotNull() & (F.col("_t") - F.col("_r._rt") <= tolerance))
    return found.select("_l.*", F.col("_r._rt").alias("asof_time"), *[F.col("_r").getField(c).alias(c) for c in columns])


def _struct(df: DataFrame, time: str, columns: list[str]) -> str:
    return df.select(F.struct(F.col(time).cast("double").alias("_rt"), *[F.col(c) for c in columns]).alias("s")).schema["s"].dataType.simpleString()


def _struct_of(df: DataFrame) -> str:
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("s")).schema["s"].dataType.simpleString()


def nearest_at(df: DataFrame, at: float, tolerance: float, time: str = "timestamp", by: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """The row (per ``by``) nearest in time to an instant within the tolerance; of equals the earlier. The range reaches the scan."""
    rows = df.where(F.col(time).between(at - tolerance, at + tolerance))
    key = F.struct(F.abs(F.col(time) - F.lit(float(at))), F.col(time), *[F.col(c) for c in tie or []])
    return rows.groupBy(*(by or [])).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns if c not in (by or [])]), key).alias("_r")).where("_r is not null").select(*(by or []), "_r.*")


def within_ranges(ranges: DataFrame, rows: DataFrame, time: str, start: str = "t_start", end: str = "t_end", width: float = 3600.0) -> DataFrame:
    """Each range with each row whose time lies in it (bounds included): an equi-join on stretches of time, then the exact test.

    Long ranges take a row per stretch they cover; the ranges' columns must not clash with the rows'."""
    lo, hi = F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long")
    a = ranges.where(F.col(end) >= F.col(start)).withColumn("_s", F.explode(F.sequence(lo, hi)))
    b = rows.where(F.col(time).isNotNull()).withColumn("_s", F.floor(F.col(time) / width).cast("long"))
    return a.join(b, "_s").where(F.col(time).between(F.col(start), F.col(end))).drop("_s")


def aggregate_ranges(ranges: DataFrame, rows: DataFrame, key: str, signal: str, agg: Column, time: str = "timestamp", start: str = "t_start", end: str = "t_end") -> DataFrame:
    """Per range (by its key) an aggregate of a signal's readings in it: one plan for all ranges. Empty ranges have null and 0."""
    bare = rows.select(F.col(time).alias("_t"), quoted(signal).cast("double").alias("_v")).where("_v is not null")
    found = within_ranges(ranges.select(key, start, end), bare, "_t", start, end).groupBy(key).agg(agg.alias("value"), F.count("_v").alias("n_rows"))
    return ranges.join(found, key, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def integrate_ranges(ranges: DataFrame, rows: DataFrame, key: str, signal: str, time: str = "timestamp", start: str = "t_start", end: str = "t_end") -> DataFrame:
    """Per range the time integral of a rate over the intervals that lie wholly in it (those across a bound don't count)."""
    from tidemark.operators.aggregates import intervals

    steps = intervals(rows, signal, time)
    inside = within_ranges(ranges.select(key, start, end), steps, "t1", start, end).where(F.col("t0") >= F.col(start))
    found = inside.groupBy(key).agg(F.sum("area").alias("value"), F.count("area").alias("n_rows"))
    return ranges.join(found, key, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def names_at(df: DataFrame, entity: str, name: str, at: float, time: str = "timestamp") -> DataFrame:
    """Per entity its name: the latest given at or before an instant, else the first after."""
    rows = df.where(F.length(F.trim(F.col(name).cast("string"))) > 0)
    rank = F.when(F.col(time) <= at, F.lit(at) - F.col(time)).otherwise(F.col(time) - F.lit(at) + F.lit(1e12))
    return rows.groupBy(entity).agg(F.min_by(F.col(name).cast("string"), F.struct(rank, F.col(name).cast("string"))).alias("name"))

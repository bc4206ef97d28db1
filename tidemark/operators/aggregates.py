"""Scalar and bucketed aggregates, time integrals, ratios, trends, capabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.functions.expr import integrated_unit, nearest_multiple, quoted
from tidemark.operators import quantiles
from tidemark.operators.ordered import with_neighbour

AGGREGATIONS = ("avg", "min", "max", "sum", "median", "stddev", "count", "integral")
#: Intervals of the integral are longer than nothing and shorter than this.
LONGEST_INTERVAL = 3600.0


def in_range(df: DataFrame, time: str, t_range: tuple[float, float] | None, date: str | None = None) -> DataFrame:
    """Rows whose time is within the range, bounds included and in either order; by date too where the table has one, so that partitions are pruned."""
    if t_range is None:
        return df
    lo, hi = sorted(map(float, t_range))
    df = df.where(F.col(time).between(lo, hi))
    if date:
        day = lambda s: F.date_format(F.timestamp_seconds(F.lit(s)), "yyyy-MM-dd")
        df = df.where(F.col(date).cast("string").between(day(lo), day(hi)))
    return df


def aggregation(name: str, x: Column) -> Column:
    """One of AGGREGATIONS but the integral; the deviation is that of a sample."""
    made = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "median": F.median, "stddev": F.stddev_samp, "count": F.count}
    if name not in made:
        raise ValueError(f"unknown aggregation {name!r}; known: {', '.join(AGGREGATIONS)}")
    return made[name](x).cast("double")


def numeric_columns(df: DataFrame, time: str = "timestamp") -> list[str]:
    """Signals' candidates: numeric columns but the time."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != time]


def aggregate(df: DataFrame, signal: str, agg: str, unit: str = "", window: str = "all", time: str = "timestamp", t_range=None, by: list[str] | None = None) -> DataFrame:
    """One row (or one per ``by``): metric, signal, aggregation, value, unit, window, n_rows, note.

    ``n_rows`` counts readings that aren't null; for the integral, the intervals that count."""
    if agg == "integral":
        return integral(df, signal, unit, window, time, t_range, by)
    rows = in_range(df, time, t_range).where(quoted(signal).isNotNull())
    if agg == "median" and not by and rows.count() > quantiles.MOST:  # one group of all rows: its distinct values are not to meet in one task
        value, n = quantiles.exact_quantile(rows.select(quoted(signal).alias("x")), "x", 0.5)
        found = df.sparkSession.createDataFrame([(value, n)], "value double, n_rows long")
        return _result(found, f"{agg}({signal})", signal, agg, unit, window, "", by)
    found = rows.groupBy(*(by or [])).agg(aggregation(agg, quoted(signal)).alias("value"), F.count(quoted(signal)).alias("n_rows"))
    return _result(found, f"{agg}({signal})", signal, agg, unit, window, "", by)


def integral(df: DataFrame, signal: str, unit: str = "", window: str = "all", time: str = "timestamp", t_range=None, by: list[str] | None = None, note: str = "trapezoid over valid intervals") -> DataFrame:
    """The time integral of a per-hour rate: the sum of (v + v before) / 2 * dt / 3600 over 0 < dt < 3600 s. Null if no interval counts."""
    rows = intervals(in_range(df, time, t_range), signal, time, by)
    found = rows.groupBy(*(by or [])).agg(F.sum("area").alias("value"), F.count("area").alias("n_rows"))
    return _result(found, f"integral({signal})", signal, "integral", integrated_unit(unit), window, note, by)


def intervals(df: DataFrame, signal: str, time: str = "timestamp", by: list[str] | None = None) -> DataFrame:
    """One row per valid interval between consecutive readings: ``by``, t0, t1 and its ``area``."""
    rows = df.where(quoted(signal).isNotNull()).select(*(by or []), F.col(time).cast("double").alias("t1"), quoted(signal).cast("double").alias("v"))
    rows = with_neighbour(rows, "t1", ["t1", "v"], by, ["v"])
    dt = F.col("t1") - F.col("prev_t1")
    return rows.where((dt > 0) & (dt < LONGEST_INTERVAL)).select(*(by or []), F.col("prev_t1").alias("t0"), "t1", ((F.col("v") + F.col("prev_v")) / 2 * dt / 3600).alias("area"))


def _result(found: DataFrame, metric: str, signal: str, agg: str, unit: str, window: str, note: str, by) -> DataFrame:
    lit = F.lit
    return found.select(*(by or []), lit(metric).alias("metric"), lit(signal).alias("signal"), lit(agg).alias("aggregation"), "value", lit(unit).alias("unit"), lit(window).alias("window"), "n_rows", lit(note).alias("note"))


def fuel_consumption(df: DataFrame, signal: str, unit: str = "L/h", window: str = "all", time: str = "timestamp", t_range=None) -> DataFrame:
    """The integral of a consumption rate, labelled as such."""
    return integral(df, signal, unit, window, time, t_range, note="integrated consumption rate").withColumn("metric", F.lit("fuel_consumption"))


def latest(df: DataFrame, signals: list[str], time: str = "timestamp", by: list[str] | None = None) -> DataFrame:
    """Per signal its last reading that isn't null: signal, value, timestamp (nulls where there is none). One pass for all."""
    last = [F.max_by(F.struct(quoted(s).cast("double").alias("value"), F.col(time).cast("double").alias("timestamp")), F.when(quoted(s).isNotNull(), F.struct(F.col(time), quoted(s)))).alias(f"_{i}") for i, s in enumerate(signals)]
    one = df.groupBy(*(by or [])).agg(*last)
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"_{i}.value").alias("value"), F.col(f"_{i}.timestamp").alias("timestamp")) for i, s in enumerate(signals)]))
    return one.select(*(by or []), pairs.alias("p")).select(*(by or []), "p.*")


def series(df: DataFrame, signal: str, bucket: float = 3600.0, agg: str = "avg", time: str = "timestamp", t_range=None, by: list[str] | None = None) -> DataFrame:
    """A trend: bucket (seconds, the nearest multiple), value, n. An unknown aggregation counts as avg."""
    agg = agg if agg in ("avg", "min", "max", "median", "sum") else "avg"
    rows = in_range(df, time, t_range).where(quoted(signal).isNotNull() & F.col(time).isNotNull())
    return rows.groupBy(*(by or []), nearest_multiple(F.col(time), bucket).alias("bucket")).agg(aggregation(agg, quoted(signal)).alias("value"), F.count("*").alias("n"))


def compare_trend(df: DataFrame, signal: str, date: str = "date", n: int = 2, agg: str = "avg", dates: list[str] | None = None) -> DataFrame:
    """The last n dates against the n before: recent, prior, delta, pct (0 if prior is 0), direction. One pass."""
    if dates is None:
        dates = sorted(r[0] for r in df.select(F.col(date).cast("string")).distinct().collect())
    new, old = dates[-n:], dates[-2 * n : -n]
    x = quoted(signal)
    part = lambda some: aggregation(agg, F.when(F.col(date).cast("string").isin(some or [""]), x))
    one = df.where(F.col(date).cast("string").isin(*(new + old or [""]))).agg(part(new).alias("recent"), part(old).alias("prior"))
    one = one.withColumn("delta", F.col("recent") - F.col("prior"))
    pct = F.when(F.col("prior") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("delta") * 100, F.abs("prior")))
    return one.withColumn("pct", pct).withColumn("direction", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("unchanged"))


def cumulative_check(df: DataFrame, signal: str, time: str = "timestamp", by: list[str] | None = None) -> DataFrame:
    """Whether a signal only ever counts up: n, increases, decreases, cumulative (under 0.1 % decreases, at least one increase)."""
    rows = df.where(quoted(signal).isNotNull()).select(*(by or []), F.col(time).alias("t"), quoted(signal).cast("double").alias("v"))
    rows = with_neighbour(rows, "t", ["v"], by, ["v"])
    d = F.col("v") - F.col("prev_v")
    found = rows.where(d.isNotNull()).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(d > 1e-9).alias("increases"), F.count_if(d < -1e-9).alias("decreases"))
    return found.withColumn("cumulative", (F.col("n") > 0) & (F.col("increases") > 0) & (F.col("decreases") / F.greatest("n", F.lit(1)) < 0.001))


def total_over(df: DataFrame, signal: str, kind: str, time: str = "timestamp", t_range=None) -> DataFrame:
    """One row with ``total``: the integral of a rate, or what a counter gained; null for other kinds."""
    if kind == "rate":
        return integral(df, signal, time=time, t_range=t_range).select(F.col("value").alias("total"))
    x = quoted(signal).cast("double")
    rows = in_range(df, time, t_range)
    return rows.agg(((F.max(x) - F.min(x)) if kind == "counter" else F.lit(None).cast("double")).alias("total"))


def per_ratio(df: DataFrame, x: tuple[str, str], y: tuple[str, str], time: str = "timestamp", t_range=None) -> DataFrame:
    """Total x per total y, each given as (signal, kind): total_x, total_y, ratio (null where total y is about zero)."""
    a = total_over(df, *x, time=time, t_range=t_range).select(F.col("total").alias("total_x"))
    b = total_over(df, *y, time=time, t_range=t_range).select(F.col("total").alias("total_y"))
    both = a.join(F.broadcast(b))  # one row each
    return both.withColumn("ratio", F.when(F.abs("total_y") > 1e-9, F.col("total_x") / F.col("total_y")))


def capabilities(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Per numeric column: signal, min, max, usable, reason ('all-null', 'constant') from a single pass."""
    names = numeric_columns(df, time)
    if not names:
        return df.sparkSession.createDataFrame([], "signal string, min double, max double, usable boolean, reason string")
    one = df.agg(*[f(quoted(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("a", F.min), ("b", F.max))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max")) for i, c in enumerate(names)]))
    reason = F.when(F.col("min").isNull(), "all-null").when(F.col("min") == F.col("max"), "constant").otherwise("")
    return one.select(rows.alias("r")).select("r.*").withColumn("reason", reason).withColumn("usable", F.col("reason") == "")


def example_requests(rows: list, limit: int = 4) -> list[str]:
    """Questions that the usable signals can answer."""
    names = [r["signal"] for r in rows if r["usable"]][:limit]
    made = [f"what is the average {n}?" for n in names[:1]] + [f"show the trend of {n}" for n in names[1:2]]
    return made + ([f"how does {names[0]} relate to {names[1]}?"] if len(names) > 1 else [])


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    """Over rows with both: n, r (four places), slope and intercept of the least-squares line of y on x."""
    a, b = quoted(x).cast("double"), quoted(y).cast("double")
    return df.where(a.isNotNull() & b.isNotNull()).agg(F.count("*").alias("n"), F.round(F.corr(a, b), 4).alias("r"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"))


def sample_rows(df: DataFrame, n: int, key: list[Column], seed: int = 0) -> DataFrame:
    """n rows by the order of a seeded hash of a key: the same ones each time. A sampling operator; n is its feature."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def decimate(df: DataFrame, order: str, most: int) -> DataFrame:
    """Every step-th row in order, at most about ``most`` of them."""
    from tidemark.operators.ordered import numbered

    step = max(1, df.count() // most)
    return numbered(df, [order], "_place").where((F.col("_place") - 1) % step == 0).drop("_place")


def column_spread(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Per numeric column: signal, std (of a sample), n."""
    names = numeric_columns(df, time)
    one = df.agg(*[f(quoted(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("s", F.stddev_samp), ("n", F.count))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(f"s{i}").alias("std"), F.col(f"n{i}").alias("n")) for i, c in enumerate(names)])).alias("r")).select("r.*")


def widest_columns(df: DataFrame, most: int = 10, time: str = "timestamp") -> list[str]:
    """Names of columns that vary: all in schema order if at most ``most``, else those of greatest raw deviation, ties by name from the end."""
    rows = [r for r in column_spread(df, time).collect() if r["n"] and r["std"]]
    if len(rows) <= most:
        return [r["signal"] for r in rows]
    return [r["signal"] for r in sorted(rows, key=lambda r: (r["std"], r["signal"]), reverse=True)[:most]]


def clean_columns(df: DataFrame, columns: list[str], most_null: float = 0.5) -> tuple[list[str], DataFrame]:
    """Columns that aren't mostly null nor constant, and the rows that have all of them. NaN counts as null."""
    x = {c: F.when(~F.isnan(quoted(c).cast("double")), quoted(c).cast("double")) for c in columns}
    one = df.agg(F.count("*").alias("n"), *[F.count(v).alias(f"n{i}") for i, v in enumerate(x.values())], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(x.values())]).first()
    kept = [c for i, c in enumerate(columns) if one["n"] and one[f"n{i}"] and 1 - one[f"n{i}"] / one["n"] <= most_null and one[f"s{i}"]]
    made = df.select(*[c for c in df.columns if c not in columns], *[x[c].alias(c) for c in kept])
    return kept, made.dropna(subset=kept) if kept else made.limit(0)

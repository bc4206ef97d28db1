"""Tracks, entities and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import geo_cell, haversine_km, magnitude
from tidemark.operators import quantiles
from tidemark.operators.aggregates import in_range, integral
from tidemark.operators.ordered import with_neighbour, with_running_sum
from tidemark.operators.timejoin import asof, names_at, nearest_at, within_ranges

#: Part of a segment within which its end counts as reached.
BOUNDARY = 1e-9


def fixes(df: DataFrame, lat: str, lon: str, time: str = "timestamp", t_range=None, by: list[str] | None = None) -> DataFrame:
    """(by,) t, lat, lon of rows that have all three."""
    rows = in_range(df, time, t_range)
    return rows.select(*(by or []), F.col(time).cast("double").alias("t"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon")).dropna(subset=["t", "lat", "lon"])


def hops(track: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Fixes with the fix before (prev_t, prev_lat, prev_lon) and the distance from it, ``hop``: 0 at the first."""
    rows = with_neighbour(track, "t", ["t", "lat", "lon"], by, ["lat", "lon"])
    return rows.withColumn("hop", F.coalesce(haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")), F.lit(0.0)))


def track_distance(df: DataFrame, lat: str, lon: str, time: str = "timestamp", t_range=None, by: list[str] | None = None) -> DataFrame:
    """One row (or one per ``by``) with ``distance_km``, two places; 0 where there is no hop."""
    return hops(fixes(df, lat, lon, time, t_range, by), by).groupBy(*(by or [])).agg(F.round(F.coalesce(F.sum("hop"), F.lit(0.0)), 2).alias("distance_km"))


def current_position(df: DataFrame, lat: str, lon: str, time: str = "timestamp", by: list[str] | None = None) -> DataFrame:
    """The last fix: t, lat, lon."""
    track = fixes(df, lat, lon, time, by=by)
    last = track.groupBy(*(by or [])).agg(F.max_by(F.struct("t", "lat", "lon"), F.struct("t", "lat", "lon")).alias("p"))
    return last.where("p is not null").select(*(by or []), "p.*")


def efficiency(readings: DataFrame, track: DataFrame, signal: str, lat: str, lon: str, per_km: float = 1.0, unit: str = "", time: str = "timestamp") -> DataFrame:
    """One row: the integral of a rate (``total``, ``unit``), the track's distance_km, and the total per so many km; null without movement."""
    total = integral(readings, signal, unit, time=time).select(F.col("value").alias("total"), "unit")
    both = total.join(F.broadcast(track_distance(track, lat, lon, time)))  # one row each
    return both.withColumn("efficiency", F.when(F.col("distance_km") > 1e-9, F.col("total") / F.col("distance_km") * F.lit(float(per_km))))


def closest_approach(track: DataFrame, lat: float, lon: float, after: Column | None = None) -> DataFrame:
    """The fix nearest to a point (at or after a time): t, lat, lon, distance_km of two places. Of equals the earliest."""
    rows = track if after is None else track.where(F.col("t") >= after)
    rows = rows.withColumn("d", haversine_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)))
    found = rows.agg(F.min_by(F.struct("t", "lat", "lon", "d"), F.struct("d", "t")).alias("p")).where("p is not null")
    return found.select("p.t", "p.lat", "p.lon", F.round("p.d", 2).alias("distance_km"))


def voyage_window(df: DataFrame, start: tuple[float, float], end: tuple[float, float], lat: str, lon: str, time: str = "timestamp") -> DataFrame:
    """Departure (nearest to the start), arrival (nearest to the end from then on, else at any time) and the track between, in one plan.

    Columns: departure_t, departure_km, arrival_t, arrival_km, track_km (one place). No fixes: no row."""
    track = fixes(df, lat, lon, time)
    left = closest_approach(track, *start).select(F.col("t").alias("departure_t"), F.col("distance_km").alias("departure_km"))
    rows = track.withColumn("d", haversine_km(F.col("lat"), F.col("lon"), F.lit(end[0]), F.lit(end[1]))).join(F.broadcast(left))  # one row
    pick = F.min_by(F.struct("t", "d"), F.struct((F.col("t") < F.col("departure_t")).cast("int"), "d", "t"))
    ends = rows.groupBy("departure_t", "departure_km").agg(pick.alias("a"))
    ends = ends.select("departure_t", "departure_km", F.col("a.t").alias("arrival_t"), F.round("a.d", 2).alias("arrival_km"))
    steps = hops(track).join(F.broadcast(ends))
    lo, hi = F.least("departure_t", "arrival_t"), F.greatest("departure_t", "arrival_t")
    inside = F.when((F.col("t") <= hi) & (F.col("prev_t") >= lo), F.col("hop"))
    return steps.groupBy("departure_t", "departure_km", "arrival_t", "arrival_km").agg(F.round(F.coalesce(F.sum(inside), F.lit(0.0)), 1).alias("track_km"))


def distance_segments(df: DataFrame, lat: str, lon: str, segment_km: float, time: str = "timestamp", t_range=None) -> DataFrame:
    """The track cut every ``segment_km``: segment, km_start, km_end, t_start, t_end; the rest is the last one.

    A hop that crosses several boundaries closes several segments, the later ones of no duration. A boundary counts as reached
    within BOUNDARY of a segment, as sums of hops are not exact.
    Cumulative distance comes from sums by stretch of time, so no task walks the whole track."""
    spark = df.sparkSession
    if segment_km <= 0:
        return spark.createDataFrame([], "segment long, km_start double, km_end double, t_start double, t_end double")
    track = fixes(df, lat, lon, time, t_range)
    rows = with_running_sum(hops(track), "t", F.col("hop"), "cum", tie=["lat", "lon"])
    seg = F.lit(float(segment_km))
    passed = lambda km: F.floor(km / seg + F.lit(BOUNDARY))
    rows = rows.withColumn("k0", passed(F.col("cum") - F.col("hop"))).withColumn("k1", passed(F.col("cum")))
    closed = rows.where("k1 > k0").select(F.explode(F.expr("sequence(k0 + 1, k1)")).alias("segment"), F.col("t").alias("t_end"))
    closed = closed.groupBy("segment").agg(F.min("t_end").alias("t_end"))
    whole = rows.agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("cum").alias("km"), F.count("*").alias("n")).where("n >= 2")
    tail = whole.where((F.col("km") - passed(F.col("km")) * seg) > 1e-6).select((passed(F.col("km")) + 1).alias("segment"), F.col("t1").alias("t_end"), F.col("km").alias("last"))
    every = closed.withColumn("last", F.lit(None).cast("double")).unionByName(tail)
    before = closed.select((F.col("segment") + 1).alias("segment"), F.col("t_end").alias("t_start"))
    every = every.join(before, "segment", "left").join(F.broadcast(whole.select("t0")))  # one row
    return every.select(F.col("segment").cast("long").alias("segment"), F.round((F.col("segment") - 1) * seg, 3).alias("km_start"), F.round(F.coalesce("last", F.col("segment") * seg), 3).alias("km_end"), F.coalesce("t_start", "t0").alias("t_start"), "t_end")


def upper_median(df: DataFrame, value: str, out: str = "median", most: int = quantiles.MOST, n: int = 0) -> DataFrame:
    """One row: the element at n // 2 (from 0) of the values in order, and their number ``n``. ``n``: rows at most; from ``most`` on no task holds them all."""
    if n > most:
        return df.sparkSession.createDataFrame([quantiles.upper_median(df, value, most)], f"{out} {dict(df.dtypes)[value]}, n long")
    x = F.col(value)
    return df.where(x.isNotNull()).agg(F.count(x).alias("n"), F.expr(f"percentile_disc(0.5) within group (order by `{value}` desc)").alias(out))


def coverage_gaps(df: DataFrame, time: str = "timestamp", t_range=None, position: DataFrame | None = None) -> DataFrame:
    """Gaps in a source's readings: t_start, t_end, duration_s, with coverage columns window_s, covered_s, coverage, threshold_s, median_dt on each.

    A gap is longer than max(5 x the upper median step, 60 s); the window's bounds count as readings. A window
    without gaps is one row with null bounds. With a position track (t, lat, lon): distance_km in each gap
    (one place) and whether it ``moving`` (over 1 km); null without."""
    stamps = in_range(df, time, t_range).select(F.col(time).cast("double").alias("t")).where("t is not null")
    steps = with_neighbour(stamps, "t", ["t"])
    steps = steps.select(F.col("prev_t").alias("a"), F.col("t").alias("b"), (F.col("t") - F.col("prev_t")).alias("d"))
    mid = upper_median(steps, "d", "median_dt", n=df.count()).where("n >= 1").select("median_dt", F.greatest(F.col("median_dt") * 5, F.lit(60.0)).alias("threshold_s"))
    if t_range is None:
        ends = stamps.agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    else:
        lo, hi = sorted(map(float, t_range))
        ends = stamps.agg(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    ends = ends.join(F.broadcast(mid))  # one row each
    outer = ends.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("t0").alias("b")), F.struct(F.col("t1").alias("a"), F.col("hi").alias("b")))).alias("e")).select("e.a", "e.b", (F.col("e.b") - F.col("e.a")).alias("d"))
    gaps = steps.where("a is not null").unionByName(outer).join(F.broadcast(mid)).where("d > threshold_s").select("a", "b", "d")
    total = gaps.agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("missing"))
    head = ends.join(F.broadcast(total)).select((F.col("hi") - F.col("lo")).alias("window_s"), (F.col("hi") - F.col("lo") - F.col("missing")).alias("covered_s"), F.try_divide(F.col("hi") - F.col("lo") - F.col("missing"), F.col("hi") - F.col("lo")).alias("coverage"), "threshold_s", "median_dt")
    out = head.join(gaps.select(F.col("a").alias("t_start"), F.col("b").alias("t_end"), F.col("d").alias("duration_s")), how="left", on=F.lit(True))
    if position is None:
        return out.withColumn("distance_km", F.lit(None).cast("double")).withColumn("moving", F.lit(None).cast("boolean"))
    inside = within_ranges(gaps.select(F.col("a").alias("t_start"), F.col("b").alias("t_end")), hops(position).select("t", "prev_t", "hop"), "t").where("prev_t >= t_start")
    moved = inside.groupBy("t_start", "t_end").agg(F.sum("hop").alias("km"))
    out = out.join(moved, ["t_start", "t_end"], "left")
    km = F.when(F.col("t_start").isNotNull(), F.coalesce("km", F.lit(0.0)))
    return out.withColumn("distance_km", F.round(km, 1)).withColumn("moving", km > 1.0).drop("km")


def nearby(own: DataFrame, others: DataFrame, at: float, radius_km: float = 50.0, tolerance: float = 300.0, own_tolerance: float = 1800.0, name: str | None = None) -> DataFrame:
    """Entities near the own position at an instant: id, name, lat, lon, t, distance_km (two places), by the nearest report of each.

    ``own``: t, lat, lon. ``others``: t, lat, lon, id (and a name column)."""
    here = nearest_at(own.select("t", "lat", "lon"), at, own_tolerance, "t", tie=["lat", "lon"]).select(F.col("lat").alias("olat"), F.col("lon").alias("olon"))
    seen = nearest_at(others.select("id", "t", "lat", "lon").where("id is not null and lat is not null and lon is not null"), at, tolerance, "t", ["id"], ["lat", "lon"])
    rows = seen.join(F.broadcast(here)).withColumn("d", haversine_km(F.col("olat"), F.col("olon"), F.col("lat"), F.col("lon"))).where(F.col("d") <= radius_km)
    if name:
        rows = rows.join(names_at(others, "id", name, at, "t"), "id", "left")
    else:
        rows = rows.withColumn("name", F.lit(None).cast("string"))
    return rows.select("id", "name", "lat", "lon", "t", F.round("d", 2).alias("distance_km"))


def entity_position(others: DataFrame, term: str, at: float, tolerance: float = 3600.0, name: str = "name") -> DataFrame:
    """Where an entity was: the one named like the term most often, else with that id; its report nearest to the instant.

    Columns id, name (the greatest it has), t, lat, lon. The term is matched literally, without case."""
    named = others.where(F.lower(F.col(name).cast("string")).contains(term.lower())).groupBy("id").count().select("id", F.lit(0).alias("rank"), (-F.col("count")).alias("c"))
    exact = others.where(F.col("id").cast("string") == term).select("id").limit(1).select("id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("c"))
    best = named.unionByName(exact).agg(F.min_by("id", F.struct("rank", "c", F.col("id").cast("string"))).alias("id")).where("id is not null")
    chosen = others.join(F.broadcast(best), "id")  # one row
    shown = chosen.groupBy("id").agg(F.max(F.col(name).cast("string")).alias("name"))
    spot = nearest_at(chosen.select("id", "t", "lat", "lon").dropna(), at, tolerance, "t", ["id"], ["lat", "lon"])
    return spot.join(shown, "id", "left").select("id", "name", "t", "lat", "lon")


def nearby_new(own: DataFrame, others: DataFrame, bucket_km: float, radius_km: float = 10.0, tolerance: float = 300.0, own_tolerance: float = 1800.0) -> DataFrame:
    """Per stretch of ``bucket_km`` along the own track, entities met there first: segment, km_start, km_end, new_count, names (up to 10, for display).

    Entities are looked for at each segment's start, middle and end; all segments in one plan."""
    segments = distance_segments(own, "lat", "lon", bucket_km, "t")
    moments = segments.select("segment", F.explode(F.array("t_start", (F.col("t_start") + F.col("t_end")) / 2, "t_end")).alias("at")).distinct()
    near_own = within_ranges(moments.select("segment", "at", (F.col("at") - own_tolerance).alias("lo"), (F.col("at") + own_tolerance).alias("hi")), own.select("t", "lat", "lon").dropna(), "t", "lo", "hi")
    here = near_own.groupBy("segment", "at").agg(F.min_by(F.struct("lat", "lon"), F.struct(F.abs(F.col("t") - F.col("at")), "t", "lat", "lon")).alias("o"))
    reports = others.select("id", F.col("t").alias("rt"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon")).dropna()
    close = within_ranges(here.select("segment", "at", "o", (F.col("at") - tolerance).alias("lo"), (F.col("at") + tolerance).alias("hi")), reports, "rt", "lo", "hi", max(60.0, tolerance))
    each = close.groupBy("segment", "at", "id", "o").agg(F.min_by(F.struct("rlat", "rlon"), F.struct(F.abs(F.col("rt") - F.col("at")), "rt", "rlat", "rlon")).alias("p"))
    met = each.where(haversine_km(F.col("o.lat"), F.col("o.lon"), F.col("p.rlat"), F.col("p.rlon")) <= radius_km)
    first = met.groupBy("id").agg(F.min("segment").alias("segment"))
    found = first.groupBy("segment").agg(F.count("*").alias("new_count"), F.slice(F.array_sort(F.collect_list(F.col("id").cast("string"))), 1, 10).alias("names"))
    return segments.select("segment", "km_start", "km_end").join(found, "segment", "left").withColumn("new_count", F.coalesce("new_count", F.lit(0).cast("long"))).withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def signal_by_location(position: DataFrame, values: DataFrame, expressions: list[str], cell: float = 0.1, tolerance: float = 600.0, time: str = "timestamp", t_range=None) -> DataFrame:
    """Per geographic cell: lat_cell, lon_cell, mean, n of a signal as of each fix; of several, their magnitude.

    ``position``: t, lat, lon; readings lack none of the parts. The as-of is backward, within the tolerance."""
    parts = [F.expr(e).cast("double") for e in expressions]
    value = parts[0] if len(parts) == 1 else magnitude(parts)
    readings = in_range(values, time, t_range).select(F.col(time).cast("double").alias("t"), value.alias("value")).where("value is not null")
    track = in_range(position.select("t", "lat", "lon").dropna(), "t", t_range)
    rows = asof(track, readings, "t", ["value"], tolerance)
    return rows.groupBy(geo_cell(F.col("lat"), cell).alias("lat_cell"), geo_cell(F.col("lon"), cell).alias("lon_cell")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def nearest_place(rows: DataFrame, places: list[dict], lat: str = "lat", lon: str = "lon", radius_km: float = 10.0, out: str = "place") -> DataFrame:
    """The rows with the nearest place in whose radius they lie (null if in none) and ``<out>_km``. Places are a small list, as literals."""
    usable = [p for p in places if p.get("name") and p.get("lat") is not None and p.get("lon") is not None]
    none = F.struct(F.lit(None).cast("double").alias("d"), F.lit(None).cast("string").alias("name"))
    options = [F.when(haversine_km(F.col(lat), F.col(lon), F.lit(float(p["lat"])), F.lit(float(p["lon"]))) <= float(p.get("radius_km") or radius_km), F.struct(haversine_km(F.col(lat), F.col(lon), F.lit(float(p["lat"])), F.lit(float(p["lon"]))).alias("d"), F.lit(p["name"]).alias("name"))).otherwise(none) for p in usable]
    best = F.array_min(F.filter(F.array(*options), lambda s: s["d"].isNotNull())) if options else none
    return rows.withColumn("_p", best).withColumn(out, F.col("_p.name")).withColumn(f"{out}_km", F.col("_p.d")).drop("_p")


def place_label(lat: float, lon: float, name: str | None = None, km: float | None = None) -> str:
    """A point in words; far from its place (over 1 km) it says how far."""
    spot = f"{lat:.5f}, {lon:.5f}"
    if not name:
        return f"({spot})"
    return f"{name} ({spot}, ~{km:.0f} km away)" if km is not None and km > 1 else f"{name} ({spot})"

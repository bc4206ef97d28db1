"""Stops, legs between them, and dwell norms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.spatial import hops, nearest_place
from tidemark.operators.timejoin import within_ranges

STOPS = "entity string, t_start double, t_end double, lat double, lon double, duration_s double, ongoing boolean"


def km_from(lat: float | np.ndarray, lon: float | np.ndarray, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    """Great-circle distances from a point, or from one each."""
    p, q = np.radians(lats), np.radians(lat)
    h = np.sin((p - q) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lons - lon) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.minimum(1.0, np.sqrt(h)))


class StopScan:
    """Stops of one entity from fixes in time order, fed in pieces; holds one anchor and no fixes."""

    def __init__(self, move_km: float, least_s: float):
        self.move_km, self.least_s = move_km, least_s
        self.anchor: tuple[float, float, float] | None = None  # t, lat, lon
        self.last = 0.0

    def feed(self, t: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> Iterator[tuple[float, float, float, float, float, bool]]:
        i, at, n = 0, -1, len(t)  # the next fix, and the anchor's place among these
        stays = np.nonzero(~(km_from(lat[:-1], lon[:-1], lat[1:], lon[1:]) > self.move_km))[0]
        while i < n:
            if self.anchor is None:
                at = self._anchored(t, lat, lon, i)
                i += 1
                continue
            if at >= 0 and at == i - 1 and self.least_s > 0:  # anchors that the very next fix leaves are no stops
                k = int(np.searchsorted(stays, at))
                stay = int(stays[k]) if k < len(stays) else n - 1
                if stay > at:
                    at = self._anchored(t, lat, lon, stay)
                    i = stay + 1
                    continue
            leave, width = i, 16  # looks ahead by as much again each time: work follows the length of the stay
            while leave < n:
                far = np.nonzero(km_from(self.anchor[1], self.anchor[2], lat[leave : leave + width], lon[leave : leave + width]) > self.move_km)[0]
                if len(far):
                    leave += int(far[0])
                    break
                leave, width = min(n, leave + width), 2 * width
            if leave > i:
                self.last = float(t[leave - 1])
            if leave == n:
                return
            yield from self._closed(False)
            at = self._anchored(t, lat, lon, leave)
            i = leave + 1

    def _anchored(self, t: np.ndarray, lat: np.ndarray, lon: np.ndarray, i: int) -> int:
        self.anchor, self.last = (float(t[i]), float(lat[i]), float(lon[i])), float(t[i])
        return i

    def _closed(self, ongoing: bool):
        t0, lat, lon = self.anchor
        if self.last - t0 >= self.least_s:
            yield t0, self.last, lat, lon, self.last - t0, ongoing

    def finish(self) -> Iterator:
        if self.anchor is not None:
            yield from self._closed(True)


def detect_stops(track: DataFrame, entity: str | None = None, move_km: float = 1.0, least_s: float = 1800.0) -> DataFrame:
    """Stops: entity, t_start, t_end, lat, lon (of the anchor), duration_s, ongoing (the last, if still within reach of its anchor).

    An anchor stays until a fix is over ``move_km`` from it, so the scan is sequential in an entity; entities run in
    parallel. Fixes stream through in time order, and only the anchor is held: an entity may have any number."""
    import pyarrow as pa

    name = F.col(entity).cast("string") if entity else F.lit("")
    rows = track.select(name.alias("entity"), F.col("t").cast("double").alias("t"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).dropna(subset=["t", "lat", "lon"])
    rows = rows.repartition("entity").sortWithinPartitions("entity", "t", "lat", "lon")

    def run(batches: Iterator) -> Iterator:
        now, scan, out = None, None, []
        for b in batches:
            who = b.column(0).to_numpy(zero_copy_only=False)
            t, lat, lon = (b.column(i).to_numpy() for i in (1, 2, 3))
            cuts = [0, *(np.nonzero(who[1:] != who[:-1])[0] + 1).tolist(), len(who)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if scan is None or who[a] != now:
                    if scan is not None:
                        out += [(now, *s) for s in scan.finish()]
                    now, scan = who[a], StopScan(move_km, least_s)
                out += [(now, *s) for s in scan.feed(t[a:z], lat[a:z], lon[a:z])]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, o, strict=True)) for o in out], schema=arrow)
                out = []
        if scan is not None:
            out += [(now, *s) for s in scan.finish()]
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(FIELDS, o, strict=True)) for o in out], schema=arrow)

    arrow = pa.schema([("entity", pa.string()), *((f, pa.float64()) for f in FIELDS[1:6]), ("ongoing", pa.bool_())])
    return rows.mapInArrow(run, STOPS)


FIELDS = ("entity", "t_start", "t_end", "lat", "lon", "duration_s", "ongoing")


def detect_legs(track: DataFrame, entity: str | None = None, places: list[dict] | None = None, move_km: float = 1.0, least_s: float = 1800.0) -> DataFrame:
    """Legs between consecutive stops that move: entity, leg (from 1), t_start, t_end, duration_h (two places), km (one), from_place, to_place."""
    stops = nearest_place(detect_stops(track, entity, move_km, least_s), places or [])
    order = Window.partitionBy("entity").orderBy("t_start")
    pairs = stops.withColumn("_n", F.lead(F.struct("t_start", "place")).over(order)).where("_n is not null and _n.t_start > t_end")
    legs = pairs.select("entity", F.col("t_end").alias("t_start"), F.col("_n.t_start").alias("t_end"), F.col("place").alias("from_place"), F.col("_n.place").alias("to_place"))
    name = F.col(entity).cast("string") if entity else F.lit("")
    own = track.select(name.alias("_e"), "t", "lat", "lon").dropna(subset=["t", "lat", "lon"])
    steps = hops(own, ["_e"]).select("_e", F.col("t").alias("_t"), "prev_t", "hop")
    inside = within_ranges(legs, steps, "_t").where((F.col("entity") == F.col("_e")) & (F.col("prev_t") >= F.col("t_start")))
    km = inside.groupBy("entity", "t_start").agg(F.sum("hop").alias("km"))
    kept = legs.join(km, ["entity", "t_start"]).where(F.col("km") > move_km)
    leg = F.row_number().over(Window.partitionBy("entity").orderBy("t_start")).cast("long")
    return kept.select("entity", leg.alias("leg"), "t_start", "t_end", F.round((F.col("t_end") - F.col("t_start")) / 3600, 2).alias("duration_h"), F.round("km", 1).alias("km"), "from_place", "to_place")


def dwell_norm(stops: DataFrame, least: int = 3) -> DataFrame:
    """Per entity, over all stops but the last: n, median_h, p90_h, max_h, and the last one's current_h; entities with under ``least`` stops are left out."""
    last = F.row_number().over(Window.partitionBy("entity").orderBy(F.col("t_start").desc()))
    rows = stops.withColumn("_r", last).withColumn("h", F.col("duration_s") / 3600)
    past = F.when(F.col("_r") > 1, F.col("h"))
    found = rows.groupBy("entity").agg(F.count("*").alias("stops"), F.count(past).alias("n"), F.median(past).alias("median_h"), F.percentile(past, 0.9).alias("p90_h"), F.max(past).alias("max_h"), F.max(F.when(F.col("_r") == 1, F.col("h"))).alias("current_h"))
    return found.where(F.col("stops") >= least).drop("stops")


def dwell_flags(stops: DataFrame, least: int = 3) -> DataFrame:
    """``dwell_norm`` with ``flagged`` (the last stop is over p90 and 1.5 medians), ``ratio`` to the median, ``confidence`` (high from 10 stops, medium from 5)."""
    rows = dwell_norm(stops, least)
    return rows.withColumn("ratio", F.try_divide("current_h", "median_h")).withColumn("flagged", (F.col("current_h") > F.col("p90_h")) & (F.col("current_h") >= 1.5 * F.col("median_h"))).withColumn("confidence", F.when(F.col("n") >= 10, "high").when(F.col("n") >= 5, "medium").otherwise("low"))


def voyage_norms(legs: DataFrame, entity: str, order: str) -> DataFrame:
    """``voyage_norm`` of each entity's legs (columns km, total) in one plan: entity, rate, median, p90, n, verdict; entities with too little are left out."""
    rate = F.when(F.col("total").isNotNull() & (F.col("km") != 0), F.col("total") / F.col("km"))
    last = F.row_number().over(Window.partitionBy(entity).orderBy(F.col(order).desc()))
    past = F.when(F.col("_k") > 1, F.col("_rate"))
    rows = legs.withColumn("_rate", rate).withColumn("_k", last)
    found = rows.groupBy(entity).agg(F.count("*").alias("_legs"), F.max(F.when(F.col("_k") == 1, F.col("_rate"))).alias("rate"), F.median(past).alias("median"), F.percentile(past, 0.9).alias("p90"), F.count(past).alias("n"))
    higher = (F.col("rate") > F.col("p90")) & (F.col("rate") >= 1.25 * F.col("median"))
    verdict = F.when(higher, "HIGHER").when(F.col("rate") < 0.75 * F.col("median"), "LOWER").otherwise("NORMAL")
    return found.where("_legs >= 3 and n >= 2 and rate is not null").select(entity, "rate", "median", "p90", "n", verdict.alias("verdict"))


def voyage_norm(legs: list[dict]) -> dict | None:
    """How the last leg's rate per km compares with those before: verdict HIGHER, LOWER or NORMAL; None if there is too little to judge by.

    ``legs``: dicts of km and total (None where unknown), in order; three legs and two usable earlier ones are needed."""
    rate = [leg["total"] / leg["km"] if leg.get("total") is not None and leg.get("km") else None for leg in legs]
    earlier = [r for r in rate[:-1] if r is not None]
    if len(legs) < 3 or len(earlier) < 2 or rate[-1] is None:
        return None
    median, p90 = float(np.median(earlier)), float(np.percentile(earlier, 90))
    verdict = "HIGHER" if rate[-1] > p90 and rate[-1] >= 1.25 * median else "LOWER" if rate[-1] < 0.75 * median else "NORMAL"
    return {"rate": rate[-1], "median": median, "p90": p90, "n": len(earlier), "verdict": verdict}

"""Operators on fixtures with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr, kernels
from tidemark.operators import aggregates as A
from tidemark.operators import anomaly as N
from tidemark.operators import discovery as D
from tidemark.operators import ordered, spatial as S
from tidemark.operators import timejoin as J
from tidemark.operators import trajectory as T


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def own(spark):
    return frame(spark, [(100.0 * i, 0.0, 0.1 * i) for i in range(20)], "t double, lat double, lon double").cache()


@pytest.fixture(scope="module")
def feed(spark):
    places = {"V1": (0.0, 0.0), "V2": (0.001, 0.0), "V3": (0.0, 1.6)}
    return frame(spark, [(float(t), *places[v], v, None) for t in range(0, 2000, 100) for v in places], "t double, lat double, lon double, id string, name string").cache()


# --- expressions

@pytest.mark.parametrize("unit, want", [("L/h", "L"), ("kg/hr", "kg"), ("L/hour", "L"), ("L/ h", "L"), ("m3 per hour", "m3"), ("", ""), (None, ""), ("rpm", "rpm"), ("m/s", "m/s"), ("degC", "degC"), ("L/hr.", "L")])
def test_integrated_unit(unit, want):
    assert expr.integrated_unit(unit) == want


@pytest.mark.parametrize("spec, want", [(2, 7200), ("minute", 60), ("hour", 3600), ("day", 86400), ("30s", 30), ("15m", 900), ("4h", 14400), ("2d", 172800), ("soon", 3600), (None, 3600)])
def test_bucket_seconds(spec, want):
    assert expr.bucket_seconds(spec) == want


def test_buckets_round_to_nearest_even(spark):
    got = [r[0] for r in frame(spark, [(2.5,), (3.5,), (2.4,), (-1.5,)], "x double").select(expr.nearest_multiple(F.col("x"), 1.0)).collect()]
    assert got == [2, 4, 2, -2]
    assert [r[0] for r in frame(spark, [(0.25,), (0.35,)], "x double").select(expr.tick(F.col("x"))).collect()] == [3, 4]


def test_haversine(spark):
    d = frame(spark, [(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double").select(expr.haversine_km(*map(F.col, "abcd"))).collect()
    assert d[0][0] == pytest.approx(math.radians(1) * 6371) and d[1][0] == pytest.approx(math.pi * 6371)


# --- ordered

def test_neighbours_across_stretches(spark):
    rows = [(float(t), i % 2, i) for i, t in enumerate([5, 10, 250, 251, 900, 3, 700, 705, 100000])]
    df = frame(spark, rows, "t double, k int, v int")
    for width in (10.0, 100.0, 1e9):
        got = {r["v"]: r["prev_v"] for r in ordered.with_neighbour(df, "t", ["v"], ["k"], width=width).collect()}
        want = {}
        for k in (0, 1):
            some = sorted(r for r in rows if r[1] == k)
            want |= {b[2]: a[2] for a, b in zip(some, some[1:], strict=False)} | {some[0][2]: None}
        assert got == want
        sums = {r["v"]: r["s"] for r in ordered.with_running_sum(df, "t", F.col("v").cast("double"), "s", ["k"], width=width).collect()}
        for k in (0, 1):
            run = 0
            for r in sorted(r for r in rows if r[1] == k):
                run += r[2]
                assert sums[r[2]] == run
    places = {r["v"]: r["p"] for r in ordered.numbered(df, ["t", "v"], "p", 4).collect()}
    assert [v for v, _ in sorted(places.items(), key=lambda x: x[1])] == [r[2] for r in sorted(rows)]


# --- aggregates

def test_integral_and_aggregates(spark):
    df = frame(spark, [(0.0, 6.0), (1800.0, 6.0), (1800.0 + 3600, 6.0), (9000.0 - 1, 12.0), (9000.0, None)], "timestamp double, v double")
    r = A.aggregate(df, "v", "integral", "L/h").first()
    assert (r["value"], r["unit"], r["n_rows"]) == (pytest.approx(3.0 + 9 * 3599 / 3600), "L", 2)
    assert A.aggregate(df, "v", "avg").first()["n_rows"] == 4
    assert A.aggregate(df.where("v > 99"), "v", "sum").first()["value"] is None
    with pytest.raises(ValueError):
        A.aggregate(df, "v", "mode").first()
    assert A.aggregate(df, "v", "count", t_range=(1800, 0)).first()["value"] == 2
    assert A.fuel_consumption(df, "v").first()["metric"] == "fuel_consumption"
    last = A.latest(df, ["v"]).first()
    assert (last["value"], last["timestamp"]) == (12.0, 8999.0)


def test_ratios_and_checks(spark):
    df = frame(spark, [(float(i), float(i * i), 5.0, None) for i in range(100)], "timestamp double, up double, flat double, void double")
    assert A.cumulative_check(df, "up").first()["cumulative"] and not A.cumulative_check(df, "flat").first()["cumulative"]
    assert A.per_ratio(df, ("up", "counter"), ("up", "counter")).first()["ratio"] == 1
    assert A.per_ratio(df, ("up", "counter"), ("flat", "counter")).first()["ratio"] is None
    reasons = {r["signal"]: r["reason"] for r in A.capabilities(df).collect()}
    assert reasons == {"up": "", "flat": "constant", "void": "all-null"}
    kept, clean = A.clean_columns(df, ["up", "flat", "void"])
    assert kept == ["up"] and clean.count() == 100
    assert A.widest_columns(df) == ["up"]
    assert A.decimate(df, "timestamp", 10).count() == 10
    days = frame(spark, [(f"2024-01-0{d}", float(v)) for d, v in ((1, 10), (2, 10), (3, 20), (4, 20))], "date string, v double")
    r = A.compare_trend(days, "v").first()
    assert (r["direction"], r["pct"]) == ("up", 100.0)


# --- joins

def test_asof_is_backward_within_tolerance(spark):
    left = frame(spark, [(10.0, "a"), (10.5, "b"), (100.0, "c"), (5.0, "d")], "t double, k string")
    right = frame(spark, [(10.0, 1.0), (9.0, 2.0), (50.0, 3.0), (39.9, 9.0)], "t double, v double")
    got = {r["k"]: r["v"] for r in J.asof(left, right, "t", ["v"], 50.0).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 3.0}
    rng = np.random.default_rng(2)
    a, b = np.sort(rng.uniform(0, 1000, 200)), np.sort(rng.uniform(0, 1000, 60))
    found = {r["t"]: r["v"] for r in J.asof(frame(spark, [(float(x),) for x in a], "t double"), frame(spark, [(float(x), float(i)) for i, x in enumerate(b)], "t double, v double"), "t", ["v"], 7.0).collect()}
    want = {float(x): float(i) for x in a for i in [np.searchsorted(b, x, "right") - 1] if i >= 0 and x - b[i] <= 7}
    assert found == want


def test_fuse(spark):
    a = frame(spark, [(0.01, 1.0), (0.04, 2.0), (1.0, 3.0)], "timestamp double, x double")
    b = frame(spark, [(0.02, 5.0), (1.0, 6.0), (2.0, 7.0)], "timestamp double, y double")
    got = sorted(tuple(r) for r in J.fuse({"s-1": a, "s2": b}).select("tg", "s_1__x", "s2__y").collect())
    assert got == [(0, 1.0, 5.0), (10, 3.0, 6.0)]
    with pytest.raises(ValueError):
        J.fuse({"a": a})


def test_ranges(spark):
    ranges = frame(spark, [(1, 0.0, 5000.0), (2, 5000.0, 5000.0), (3, 9e5, 9e5 + 1)], "k int, t_start double, t_end double")
    rows = frame(spark, [(1000.0 * i, float(i)) for i in range(10)], "timestamp double, v double")
    got = {r["k"]: (r["value"], r["n_rows"]) for r in J.aggregate_ranges(ranges, rows, "k", "v", F.sum("_v")).collect()}
    assert got == {1: (15.0, 6), 2: (5.0, 1), 3: (None, 0)}
    area = {r["k"]: r["n_rows"] for r in J.integrate_ranges(ranges, rows, "k", "v").collect()}
    assert area == {1: 5, 2: 0, 3: 0}


# --- tracks

def test_tracks(spark, own):
    hop = math.radians(0.1) * 6371
    assert S.track_distance(own, "lat", "lon", "t").first()[0] == pytest.approx(19 * hop, abs=0.01)
    assert S.track_distance(own.where("t < 0"), "lat", "lon", "t").first()[0] == 0
    r = S.closest_approach(own, 0.0, 0.52).first()
    assert (r["t"], r["distance_km"]) == (500.0, pytest.approx(2.22, abs=0.01))
    v = S.voyage_window(own, (0.0, 0.5), (0.0, 1.0), "lat", "lon", "t").first()
    assert (v["departure_t"], v["arrival_t"], v["track_km"]) == (500.0, 1000.0, pytest.approx(5 * hop, abs=0.06))
    assert S.voyage_window(own.where("t < 0"), (0.0, 0.5), (0.0, 1.0), "lat", "lon", "t").count() == 0


def test_segments_equal_a_walk(spark, own):
    for size in (3.0, 25.0, 50.0):
        cum, at, want, start = 0.0, 1, [], 0.0
        points = [(r["t"], r["lon"]) for r in own.orderBy("t").collect()]
        for (_, x), (t, y) in zip(points, points[1:], strict=False):
            cum += math.radians(y - x) * 6371
            while cum >= at * size:
                want.append((at, round((at - 1) * size, 3), round(at * size, 3), start, t))
                start, at = t, at + 1
        if cum - (at - 1) * size > 1e-6:
            want.append((at, round((at - 1) * size, 3), round(cum, 3), start, points[-1][0]))
        got = [tuple(r) for r in S.distance_segments(own, "lat", "lon", size, "t").orderBy("segment").collect()]
        assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-3)
    assert S.distance_segments(own, "lat", "lon", 0, "t").count() == 0
    assert S.distance_segments(own.limit(1), "lat", "lon", 5, "t").count() == 0


def test_new_entities_along_the_way(spark, own, feed):
    rows = S.nearby_new(own, feed, 50.0, 5.0).orderBy("segment").collect()
    assert rows[0]["new_count"] == 2 and sum(r["new_count"] for r in rows) == 3
    assert S.nearby_new(own.limit(0), feed.limit(0), 50.0).count() == 0


def test_entities(spark, own, feed):
    rows = S.nearby(own, feed, 0.0, 5.0).orderBy("distance_km").collect()
    assert [(r["id"], r["distance_km"]) for r in rows] == [("V1", 0.0), ("V2", 0.11)]
    named = feed.withColumn("name", F.when((F.col("id") == "V2") & (F.col("t") == 500), "Grey Gull").when((F.col("id") == "V2") & (F.col("t") == 1500), "Gull"))
    assert S.entity_position(named, "gull", 800.0).first()["id"] == "V2"
    assert S.entity_position(named, "V3", 800.0).first()["lon"] == 1.6
    assert S.entity_position(named, "100%", 800.0).count() == 0
    assert J.names_at(named, "id", "name", 600.0, "t").first()["name"] == "Grey Gull"
    assert J.names_at(named, "id", "name", 100.0, "t").first()["name"] == "Grey Gull"


def test_coverage(spark):
    stamps = [float(t) for t in [*range(0, 301, 10), *range(900, 1201, 10)]]
    source = frame(spark, [(t, 1.0) for t in stamps], "timestamp double, rpm double")
    track = frame(spark, [(30.0 * i, 0.0, 0.02 * i) for i in range(41)], "t double, lat double, lon double")
    rows = S.coverage_gaps(source, "timestamp", (0, 1200), track).collect()
    assert len(rows) == 1 and rows[0]["coverage"] == pytest.approx(0.5, abs=0.02) and rows[0]["moving"] and rows[0]["distance_km"] > 1
    assert S.coverage_gaps(source, "timestamp", (0, 1200)).first()["moving"] is None
    steady = frame(spark, [(5.0 * i, 1.0) for i in range(200)], "timestamp double, v double")
    rows = S.coverage_gaps(steady, "timestamp", (0, 995)).collect()
    assert len(rows) == 1 and rows[0]["coverage"] >= 0.99 and rows[0]["t_start"] is None


def test_places(spark):
    places = [{"name": "pier", "lat": 0.0, "lon": 0.0, "radius_km": 5}, {"name": "yard", "lat": 0.0, "lon": 1.0, "radius_km": 5}, {"name": "nowhere"}]
    rows = S.nearest_place(frame(spark, [(0.0, 0.01), (0.0, 0.99), (0.0, 0.5)], "lat double, lon double"), places).collect()
    assert [r["place"] for r in rows] == ["pier", "yard", None]
    assert S.place_label(1, 2) == "(1.00000, 2.00000)" and "away" in S.place_label(1, 2, "pier", 3.2) and "away" not in S.place_label(1, 2, "pier", 0.4)


def anchor_stops(points, move, least):
    out, anchor, last = [], None, None
    for t, lat, lon in points:
        if anchor and T.km_from(anchor[1], anchor[2], np.array([lat]), np.array([lon]))[0] <= move:
            last = t
            continue
        if anchor and last - anchor[0] >= least:
            out.append((anchor[0], last, False))
        anchor, last = (t, lat, lon), t
    if anchor and last - anchor[0] >= least:
        out.append((anchor[0], last, True))
    return out


def test_stops_follow_their_anchor(spark):
    rng = np.random.default_rng(4)
    rows = []
    for who in ("a", "b", "c"):
        lat, lon, t = 10.0, 20.0, 0.0
        for _ in range(400):
            t += float(rng.uniform(30, 300))
            if rng.random() < 0.06:
                lat += float(rng.normal(0, 0.05))
            lat, lon = lat + float(rng.normal(0, 0.001)), lon + float(rng.normal(0, 0.001))
            rows.append((who, t, lat, lon))
    got = T.detect_stops(frame(spark, rows, "who string, t double, lat double, lon double"), "who").collect()
    for who in ("a", "b", "c"):
        want = anchor_stops(sorted(r[1:] for r in rows if r[0] == who), 1.0, 1800.0)
        assert sorted((r["t_start"], r["t_end"], r["ongoing"]) for r in got if r["entity"] == who) == want


def test_scan_is_the_same_in_pieces():
    rng = np.random.default_rng(0)
    t, lat, lon = np.arange(300.0) * 200, np.cumsum(rng.normal(0, 0.003, 300)), np.zeros(300)
    whole, parts = T.StopScan(1.0, 1800.0), T.StopScan(1.0, 1800.0)
    a = [*whole.feed(t, lat, lon), *whole.finish()]
    b = [s for i in range(0, 300, 7) for s in parts.feed(t[i : i + 7], lat[i : i + 7], lon[i : i + 7])] + [*parts.finish()]
    assert a == b and a


def test_scan_where_each_fix_is_far():
    n = 20_000
    t, lat, lon = np.arange(float(n)), np.arange(n) % 20 * 0.05, np.zeros(n)
    looked, scan, real = [0], T.StopScan(1.0, 1800.0), T.km_from
    try:
        T.km_from = lambda a, b, lats, lons: (looked.append(len(lats)), real(a, b, lats, lons))[1]
        assert [*scan.feed(t, lat, lon), *scan.finish()] == []
        lat[5000:9000] = 7.0  # a stop among them
        scan = T.StopScan(1.0, 1800.0)
        assert [*scan.feed(t, lat, lon), *scan.finish()] == [(5000.0, 8999.0, 7.0, 0.0, 3999.0, False)]
    finally:
        T.km_from = real
    assert sum(looked) < 5 * n  # distances taken, of n * n / 2 by pairs


def test_legs_and_norms(spark):
    rows, t = [], 0.0
    for stop in range(5):
        for _ in range(20):
            rows.append((t, 0.1 * stop, 0.0))
            t += 300
    track = frame(spark, rows, "t double, lat double, lon double")
    legs = T.detect_legs(track, None, [{"name": "start", "lat": 0.0, "lon": 0.0}]).orderBy("leg").collect()
    assert [r["leg"] for r in legs] == [1, 2, 3, 4] and legs[0]["km"] == pytest.approx(11.1, abs=0.1) and legs[0]["from_place"] == "start"
    flags = T.dwell_flags(T.detect_stops(track)).first()
    assert flags["n"] == 4 and not flags["flagged"]
    three = [{"km": 100.0, "total": x} for x in (100.0, 110.0, 300.0)]
    assert T.voyage_norm(three)["verdict"] == "HIGHER"
    assert T.voyage_norm([{"km": 100.0, "total": None}, *three[1:]]) is None


# --- kernels and discovery

def test_distance_correlation():
    rng = np.random.default_rng(0)
    for n in (3, 17, 400):
        x = rng.normal(size=n).round(1)
        y = np.sin(3 * x) + rng.normal(0, 0.1, n).round(1)
        assert kernels.distance_correlation(x, y) == pytest.approx(kernels.distance_correlation_naive(x, y), abs=1e-9)
    x = rng.normal(size=2000)
    assert kernels.distance_correlation(x, np.ones(2000)) == 0 and kernels.distance_correlation(x, 1 + 1e-13 * x) == 0
    assert kernels.distance_correlation(x, 2 * x + 1) == pytest.approx(1)


@pytest.mark.parametrize("pair, want", [((0.9, 0.05), "none"), ((0.9, 0.95), "linear"), ((0.1, 0.8), "nonlinear"), ((0.3, 0.3), "linear")])
def test_classify(spark, pair, want):
    assert D.classify(*pair) == want
    assert spark.range(1).select(D.classify_column(F.lit(pair[0]), F.lit(pair[1]))).first()[0] == want


def test_common_driver(spark):
    rng = np.random.default_rng(0)
    c = rng.normal(size=4000)
    data = np.stack([c + rng.normal(0, 0.3, 4000), c + rng.normal(0, 0.3, 4000), c, rng.normal(size=4000)], axis=1)
    edges = {(r["a"], r["b"]): r for r in D.pairwise_dependence(spark, ["A", "B", "C", "D"], data).collect()}
    assert edges["A", "B"]["pearson"] > 0.8 and edges["A", "B"]["partial"] < 0.2 and edges["A", "B"]["direct"] is False
    assert edges["A", "C"]["partial"] > 0.3 and edges["A", "C"]["direct"] is True


def test_block_permutation():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=2000).cumsum(), rng.normal(size=2000).cumsum()
    assert kernels.distance_correlation(a, b) > 0.2 and kernels.block_pvalue(a, b) > 0.05
    x = rng.normal(size=800)
    assert kernels.block_pvalue(x, 2 * x + rng.normal(0, 0.1, 800), n_perm=49) <= 0.05
    assert kernels.block_pvalue(x[:5], x[:5]) == 1.0


def test_chi2():
    assert [round(kernels.chi2_quantile(0.999, d), 3) for d in (1, 2, 3)] == [10.828, 13.816, 16.266]


def test_dcor_over_all_events(spark):
    from tidemark.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value").dropna().collect()
    assert 200 < len(rows) <= 10_000
    a, b = (np.abs(v[:, None] - v[None, :]) for v in (np.array([r["value"] for r in rows], float), np.array([r["event_id"] % 17 for r in rows], float)))
    a, b = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (a, b))
    want = math.sqrt((a * b).mean() / math.sqrt((a * a).mean() * (b * b).mean()))
    assert Q.QUERIES["dcor_events"](spark, sf).first()[0] == pytest.approx(want, abs=1e-3)


def test_mutual_information_sees_the_whole_sample():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=6000), rng.normal(size=6000)
    y[2000:] = x[2000:] + 0.01 * rng.normal(size=4000)
    row = D.pair_rows(np.column_stack([x, y]), ["x", "y"], [(0, 1)], None, True, 0, 0)[0]
    assert row[4] > 0.5 and row[4] == kernels.mutual_information(x, y, seed=0)


def test_mutual_information():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    assert kernels.mutual_information(x, rng.normal(size=500)) < 0.1 < 0.5 < kernels.mutual_information(x, x**2)


@pytest.fixture(scope="module")
def regimes(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1200):
        k = (i // 100) % 3
        x = rng.normal((0, 10, 20)[k], 0.5)
        rows.append((float(i), f"2024-01-{1 + i // 300:02d}", float(x), float((-1) ** k * x + rng.normal(0, 0.3)), float(rng.normal()), float(i)))
    return frame(spark, rows, "timestamp double, date string, a double, b double, c double, counter double").cache()


def test_regimes(spark, regimes):
    model = D.segment_regimes(regimes, ["a", "b"])
    assert model["k"] == 3 and model["silhouette"] > 0.7
    profiles = D.regime_profiles(D.assign_labels(regimes, model), ["a", "b"]).collect()
    assert sorted(p["size"] for p in profiles) == [400, 400, 400]
    assert D.assign_labels(regimes.drop("b"), model).count() == 1200
    graphs = D.regime_graphs(regimes, ["a", "b", "c"], model)
    assert {r["scope"] for r in graphs["edges"].collect()} == {"global", "regime 0", "regime 1", "regime 2"}
    assert D.regime_graphs(regimes.limit(10), ["a", "b"])["k"] == 0
    runs = N.runs(D.label_sequence(regimes, model)).count()
    assert runs == 12


def test_labels_are_made_once(spark, regimes, monkeypatch):
    seen, real = {}, D.build_graph
    monkeypatch.setattr(D, "build_graph", lambda df, columns, scope="global", *a: (seen.setdefault(scope, df), real(df, columns, scope, *a))[1])
    D.regime_graphs(regimes, ["a", "b", "c"])
    plans = {k: x._jdf.queryExecution().optimizedPlan().toString() for k, x in seen.items()}
    assert len(plans) >= 3 and not any("array_position" in x for x in plans.values())


def test_baseline_against_itself(spark, regimes):
    base = N.build_baseline(regimes, ["a", "b", "c", "counter"])
    found = N.detect_drift(regimes, base)
    assert found["structure"] == [] and found["regimes"] == []
    assert all(r["fraction"] <= 0.02 for r in found["joint"])
    assert not any("counter" in e["columns"] for e in base["envelopes"].values())
    changed = regimes.withColumn("b", F.when(F.col("a") > 5, F.col("c") * 3).otherwise(F.col("b")))
    assert "departures, not causes" in N.render_drift(N.detect_drift(changed, base))
    nets = N.train_autoencoders(D.assign_labels(regimes, base["model"]), ["a", "b"], most=400)
    rows = N.autoencoder_errors(D.assign_labels(regimes, base["model"]), ["a", "b"], nets)
    assert rows.where("flagged").count() <= 0.02 * 1200


def test_autoencoder_threshold_is_over_all_rows(spark):
    rng = np.random.default_rng(4)
    rows = frame(spark, [(0, float(x), float(y)) for x, y in rng.normal(size=(6000, 2))], "label int, a double, b double")
    nets = N.train_autoencoders(rows, ["a", "b"], most=300)
    errors = np.array([r["error"] for r in N.autoencoder_errors(rows, ["a", "b"], nets).collect()])
    assert nets[0][1] == np.sort(errors)[int(np.ceil(0.999 * 6000)) - 1]
    assert (errors > nets[0][1]).sum() == 6


def test_transitions(spark):
    seq = frame(spark, [(float(i), x) for i, x in enumerate([0, 1, 2] * 20)], "t double, label int")
    base = N.transitions(seq)
    assert sum(r["cnt"] for r in base.collect()) == 59 and base.where("from_label = 0 and to_label = 1").first()["prob"] == 1.0
    window = N.transitions(frame(spark, [(float(i), x) for i, x in enumerate([0, 2] * 3)], "t double, label int"))
    kinds = {(r["kind"], r["from_label"], r["to_label"]) for r in N.transition_findings(base, window).collect()}
    assert ("unseen", 0, 2) in kinds and ("absent", 0, 1) in kinds
    runs = N.runs(frame(spark, [(float(i), x) for i, x in enumerate([0, 0, 0, 1, 1, 2, 2, 2, 0])], "t double, label int")).orderBy("t").collect()
    assert [r["label"] for r in runs] == [0, 1, 2, 0]


def test_envelope(spark):
    rng = np.random.default_rng(0)
    data = rng.multivariate_normal([0, 0, 0], [[1, 0.8, 0.8], [0.8, 1, 0.8], [0.8, 0.8, 1]], 3000)
    df = frame(spark, [tuple(map(float, r)) for r in data], "x double, y double, z double")
    e = N.fit_envelope(df, ["x", "y", "z"])
    d = N.distance_column(e["columns"], e["mean"], e["inverse"])
    assert df.where(d > e["threshold"]).count() <= 30
    odd = frame(spark, [(2.5, -2.5, 0.0)], "x double, y double, z double")
    r = odd.select(d.alias("d"), N.contribution_columns(e["columns"], e["mean"], e["inverse"]).alias("c")).first()
    assert r["d"] > e["threshold"] and {c["signal"] for c in sorted(r["c"], key=lambda c: -c["share"])[:2]} == {"x", "y"}
    assert N.fit_envelope(df.limit(10), ["x", "y"]) is None


def test_autoencoder():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, 2000)
    data = np.stack([x, np.sin(3 * x), x**2], axis=1) + rng.normal(0, 0.03, (2000, 3))
    net = kernels.Autoencoder(3).fit(data)
    limit = np.quantile(net.errors(data), 0.999)
    assert (net.errors(data) > limit).mean() <= 0.01 and net.errors(np.array([[0.0, 0.0, 1.0]]))[0] > limit


@pytest.mark.parametrize("steps, total, want", [([0.01, 0.01], [0.01, 0.02], "stable"), ([0.01, 0.5, 0.01], [0.01, 0.5, 0.5], "sudden_break"), ([0.03, 0.03, 0.03], [0.03, 0.06, 0.09], "slow_drift"), ([], [], "insufficient_history")])
def test_periods(steps, total, want):
    assert N.classify_periods(steps, total) == want


def test_groups_of_dates():
    assert N.group_dates(["2026-09-03", "2026-09-01", "2026-10-02"], "month") == {"2026-09": ["2026-09-01", "2026-09-03"], "2026-10": ["2026-10-02"]}


def test_drift_over_days(spark, regimes):
    model = D.segment_regimes(regimes, ["a", "b"])
    daily = N.daily_fingerprints(regimes, ["a", "b", "c"], model)
    found = N.multiscale_drift(daily)
    assert found["periods"] == [f"2024-01-0{d}" for d in (1, 2, 3, 4)] and len(found["steps"]) == 3
    assert N.match_regimes([{"label": 0, "centroid": {"a": 1.0}}, {"label": 1, "centroid": {"a": 10.0}}], [{"label": 5, "centroid": {"a": 9.0}}, {"label": 6, "centroid": {"a": 500.0}}]) == {5: 1}


def test_order_statistics_of_large_columns(spark):
    import random

    from tidemark.operators import quantiles

    rng = random.Random(2)
    for values in ([rng.gauss(0, 1) for _ in range(5001)], [float(rng.randrange(4)) for _ in range(4000)], [7.0] * 3000, [1.0] * 2900 + [rng.random() for _ in range(100)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(3)
        order = sorted(values)
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            want = float(np.quantile(values, q))
            assert quantiles.exact_quantile(df, "x", q, most=300) == (pytest.approx(want), len(values))
            assert quantiles.exact_quantile(df, "x", q)[0] == pytest.approx(want)
        assert quantiles.upper_median(df, "x", most=300) == (order[len(order) // 2], len(order))
        assert tuple(S.upper_median(df, "x", most=300, n=len(values)).select("median", "n").first()) == tuple(S.upper_median(df, "x").select("median", "n").first())
    assert quantiles.exact_quantile(spark.createDataFrame([], "x double"), "x", 0.5) == (None, 0)

"""Further telemetry queries: sources and their layout, legs' norms, shares of a distance, streams. Registered beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import anomaly as N
from tidemark.operators import discovery as D
from tidemark.operators import spatial as S
from tidemark.operators import timejoin as J
from tidemark.operators import trajectory as T
from tidemark.plans.queries import _DAY, _HOPS, _LAB, _STOPS, AT, CENTRES, E, daily, events, hav, query, r6
from tidemark.sources import layout
from tidemark.sources.scratch import scratch


# --- sources

def asset(spark: SparkSession, d: str) -> layout.Layout:
    """The events as an asset on disk: a source per event type, partitioned by date."""
    root = scratch(spark, "asset")
    rows = events(spark, d).withColumnRenamed("t", "timestamp")
    for source in ("click", "purchase"):
        rows.where(F.col("source") == source).write.partitionBy("date").parquet(f"{root}/vessel-001/{source}/logs")
    return layout.Layout(spark, root)


@query(f"""{E}, w AS (SELECT source, date FROM e WHERE source IN ('click', 'purchase') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY date DESC) AS k FROM w)
SELECT source, count(*) AS n, round(sum(value), 4) AS total, min(date) AS first, max(date) AS last FROM e JOIN r USING (source, date) WHERE k <= 7 GROUP BY source""")
def last_week_of_sources(spark, d):
    place = asset(spark, d)
    out = None
    for s in place.sources():
        dates, _ = place.window(s, days=7)
        part = place.read(s, dates).agg(F.lit(s).alias("source"), F.count("*").alias("n"), r6(F.sum("value"), 4).alias("total"), F.min("date").alias("first"), F.max("date").alias("last"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""{E} SELECT source, date, count(*) AS n FROM e WHERE source IN ('click', 'purchase') AND date BETWEEN '2024-01-05' AND '2024-01-09' GROUP BY ALL""")
def dates_within(spark, d):
    place = asset(spark, d)
    out = None
    for s in place.sources():
        dates, _ = place.window(s, start="2024-01-05", end="2024-01-09")
        part = place.read(s, dates).groupBy("date").agg(F.lit(s).alias("source"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.select("source", "date", "n")


@query("SELECT CAST(s_suppkey AS DOUBLE) AS s_suppkey, CAST(s_nationkey AS DOUBLE) AS s_nationkey, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier WHERE s_acctbal > 0")
def numeric_columns(spark, d):
    return layout.numeric(spark.read.parquet(f"{d}/supplier.parquet"), "s_acctbal > 0").select("s_suppkey", "s_nationkey", "s_acctbal")


@query(f"{E} SELECT round(t, 6) AS t, CAST(event_id AS DOUBLE) AS event_id, value FROM e WHERE source = 'click'")
def numeric_with_time(spark, d):
    rows = layout.numeric_with_time(events(spark, d).select("t", "source", "event_id", "value"), "source = 'click'", time="t")
    return rows.select(r6("t").alias("t"), "event_id", "value")


@query("SELECT CAST(r_regionkey AS DOUBLE) AS key, r_name AS name, NULL::VARCHAR AS mark FROM region UNION ALL SELECT s_acctbal, s_name, 'supplier' FROM supplier")
def united_by_name(spark, d):
    a = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").cast("int").alias("key"), F.col("r_name").alias("name"))
    b = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_acctbal").cast("double").alias("key"), F.col("s_name").alias("name"), F.lit("supplier").alias("mark"))
    return layout.unite([a, b])


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem WHERE l_quantity >= 30 AND l_linestatus = 'O' GROUP BY l_returnflag")
def bound_parameters(spark, d):
    table = layout.Table(spark, f"{d}/lineitem.parquet")
    return table.query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM {src} WHERE l_quantity >= :least AND l_linestatus = :status GROUP BY l_returnflag", least=30, status="O")


# --- aggregates, legs, joint values

@query(f"""{E}, x AS (SELECT *, lag(t) OVER w AS pt, lag(value) OVER w AS pv FROM e WINDOW w AS (ORDER BY t, value))
SELECT 'fuel_consumption' AS metric, round(sum((value + pv) / 2 * (t - pt) / 3600), 6) AS value, count(*) AS n_rows FROM x WHERE t - pt > 0 AND t - pt < 3600""")
def fuel_total(spark, d):
    return A.fuel_consumption(events(spark, d), "value", time="t").select("metric", r6("value").alias("value"), "n_rows")


@query(f"""{E} SELECT round(t, 6) AS t, round({hav('olat', 'olon', '57.5', '-3.5')}, 2) AS distance_km FROM e WHERE t >= {AT} ORDER BY {hav('olat', 'olon', '57.5', '-3.5')}, t LIMIT 1""")
def closest_after(spark, d):
    x = S.closest_approach(S.fixes(events(spark, d), "olat", "olon", "t"), 57.5, -3.5, F.lit(AT))
    return x.select(r6("t").alias("t"), "distance_km")


@query("""WITH r AS (SELECT o_custkey AS entity, CAST(o_totalprice AS DOUBLE) / (o_orderkey % 50 + 1.37e0) AS rate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders),
g AS (SELECT entity, count(*) AS legs, max(rate) FILTER (WHERE k = 1) AS rate, median(rate) FILTER (WHERE k > 1) AS median, quantile_cont(rate, 0.9) FILTER (WHERE k > 1) AS p90, count(*) FILTER (WHERE k > 1) AS n FROM r GROUP BY entity)
SELECT entity, round(rate, 4) AS rate, round(median, 4) AS median, round(p90, 4) AS p90, n, CASE WHEN rate > p90 AND rate >= 1.25 * median THEN 'HIGHER' WHEN rate < 0.75 * median THEN 'LOWER' ELSE 'NORMAL' END AS verdict FROM g WHERE legs >= 3 AND n >= 2""")
def voyage_norms(spark, d):
    legs = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("entity"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_totalprice").cast("double").alias("total"), (F.col("o_orderkey") % 50 + F.lit(1.37)).alias("km"))
    return T.voyage_norms(legs, "entity", "at").select("entity", r6("rate", 4).alias("rate"), r6("median", 4).alias("median"), r6("p90", 4).alias("p90"), "n", "verdict")


@query(f"""{_STOPS}, {_HOPS}, p AS (SELECT t1 AS a, lead(t0) OVER (ORDER BY t0) AS b FROM stops),
l AS (SELECT a, b, sum(hop) AS km FROM p JOIN h ON h.t BETWEEN a AND b AND h.pt >= a WHERE b > a GROUP BY a, b),
k AS (SELECT row_number() OVER (ORDER BY a) AS leg, round(a, 6) AS t_start, a, b FROM l WHERE km > 1),
x AS (SELECT *, lag(t) OVER w2 AS xpt, lag(value) OVER w2 AS pv FROM e WINDOW w2 AS (ORDER BY t, value)),
iv AS (SELECT xpt AS i0, t AS i1, (value + pv) / 2 * (t - xpt) / 3600 AS area FROM x WHERE t - xpt > 0 AND t - xpt < 3600)
SELECT leg, t_start, round(sum(area), 6) AS value, count(area) AS n_rows FROM k LEFT JOIN iv ON i1 BETWEEN a AND b AND i0 >= a GROUP BY leg, t_start""")
def leg_totals(spark, d):
    ev = events(spark, d)
    legs = T.detect_legs(ev.select("t", "lat", "lon")).select("leg", "t_start", "t_end")
    return J.integrate_ranges(legs, ev, "leg", "value", "t").select("leg", r6("t_start").alias("t_start"), r6("value").alias("value"), "n_rows")


@query("""WITH m AS (SELECT avg(l_quantity) AS a, avg(l_discount) AS b, var_samp(l_quantity) AS va, var_samp(l_discount) AS vb, covar_samp(l_quantity, l_discount) AS c FROM lineitem),
k AS (SELECT a, b, va * 1.001 AS p, vb * 1.001 AS q, c FROM m),
d AS (SELECT l_orderkey, l_linenumber, l_quantity - a AS x, l_discount - b AS y, (q * pow(l_quantity - a, 2) - 2 * c * (l_quantity - a) * (l_discount - b) + p * pow(l_discount - b, 2)) AS s, p, q, c FROM lineitem, k)
SELECT l_orderkey, l_linenumber, round(x * (q * x - c * y) / s, 4) AS quantity_share, round(y * (p * y - c * x) / s, 4) AS discount_share FROM d WHERE s / (p * q - c * c) > 5""")
def contributions(spark, d):
    df = spark.read.parquet(f"{d}/lineitem.parquet")
    e = N.fit_envelope(df, ["l_quantity", "l_discount"])
    x = df.where(N.distance_column(e["columns"], e["mean"], e["inverse"]) > 5).withColumn("c", N.contribution_columns(e["columns"], e["mean"], e["inverse"]))
    share = lambda i, name: r6(F.get("c", F.lit(i))["share"], 4).alias(name)
    return x.select("l_orderkey", "l_linenumber", share(0, "quantity_share"), share(1, "discount_share"))


@query(f"""WITH d AS (SELECT l_orderkey, l_linenumber, {_LAB} FROM lineitem)
SELECT CAST(l_orderkey AS DOUBLE) + l_linenumber / 10.0 AS t, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS label FROM d""")
def label_sequence(spark, d):
    df = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("t", F.col("l_orderkey").cast("double") + F.col("l_linenumber") / F.lit(10.0))
    return D.label_sequence(df, CENTRES, "t")


@query("""WITH p AS (SELECT l_linenumber AS label, count(*) AS size, avg(l_quantity) AS q, avg(l_discount) AS x FROM lineitem GROUP BY 1),
t AS (SELECT sum(size) AS n, sum(size * q) / sum(size) AS mq, sum(size * x) / sum(size) AS mx FROM p),
s AS (SELECT mq, mx, sqrt((SELECT sum(size * pow(q - mq, 2)) FROM p) / n) AS sq, sqrt((SELECT sum(size * pow(x - mx, 2)) FROM p) / n) AS sx FROM t)
SELECT 'l_quantity' AS signal, round(mq, 6) AS mean, round(sq, 6) AS spread FROM s UNION ALL SELECT 'l_discount', round(mx, 6), round(sx, 6) FROM s""")
def centroid_spread(spark, d):
    df = spark.read.parquet(f"{d}/lineitem.parquet")
    found = D.centroid_spread(D.regime_profiles(df, ["l_quantity", "l_discount"], "l_linenumber"), ["l_quantity", "l_discount"])
    return found.select("signal", r6("mean").alias("mean"), r6("spread").alias("spread"))


# --- periods

@query(f"""{E}, {_DAY}, ds AS (SELECT date, lag(date) OVER (ORDER BY date) AS before, min(date) OVER () AS first FROM (SELECT DISTINCT date FROM dy)),
m AS (SELECT ds.date, a.scope, a.edge, ds.before AS other, 'step' AS kind, a.dcor AS d1 FROM ds JOIN dy a ON a.date = ds.date WHERE before IS NOT NULL
 UNION ALL SELECT ds.date, a.scope, a.edge, ds.first, 'cumulative', a.dcor FROM ds JOIN dy a ON a.date = ds.date WHERE before IS NOT NULL),
o AS (SELECT ds.date, b.scope, b.edge, ds.before AS other, 'step' AS kind, b.dcor AS d2 FROM ds JOIN dy b ON b.date = ds.before
 UNION ALL SELECT ds.date, b.scope, b.edge, ds.first, 'cumulative', b.dcor FROM ds JOIN dy b ON b.date = ds.first WHERE before IS NOT NULL),
sh AS (SELECT DISTINCT m.date, m.kind, m.scope FROM m JOIN o USING (date, kind, scope)),
j AS (SELECT coalesce(m.date, o.date) AS date, coalesce(m.kind, o.kind) AS kind, coalesce(m.scope, o.scope) AS scope, abs(coalesce(d1, 0) - coalesce(d2, 0)) AS x FROM m FULL JOIN o ON m.date = o.date AND m.kind = o.kind AND m.scope = o.scope AND m.edge = o.edge),
v AS (SELECT date, kind, round(avg(x), 4) AS x FROM j SEMI JOIN sh USING (date, kind, scope) GROUP BY ALL),
w AS (SELECT ds.date AS period, coalesce(max(x) FILTER (WHERE kind = 'step'), 0) AS step, coalesce(max(x) FILTER (WHERE kind = 'cumulative'), 0) AS cumulative FROM ds LEFT JOIN v USING (date) WHERE before IS NOT NULL GROUP BY ds.date),
c AS (SELECT max(step) AS most, list_sort(list(step))[(count(*) // 2) + 1] AS middle, arg_max(cumulative, period) AS final FROM w)
SELECT period, step, cumulative, CASE WHEN most > greatest(2.5 * middle, 0.08) THEN 'sudden_break' WHEN final >= 0.08 THEN 'slow_drift' ELSE 'stable' END AS classification FROM w, c""")
def period_distances(spark, d):
    found = N.multiscale_drift(daily(events(spark, d)).select("date", "scope", "edge", "dcor"))
    rows = [(p, float(s), float(c), found["classification"]) for p, s, c in zip(found["periods"][1:], found["steps"], found["cumulative"], strict=True)]
    return spark.createDataFrame(rows, "period string, step double, cumulative double, classification string")


# --- streams

@query(f"""{E}, w AS (SELECT source, value, unnest([CAST(floor(t / 3600) * 3600 AS BIGINT), CAST(floor(t / 3600) * 3600 AS BIGINT) - 3600]) AS t_start FROM e)
SELECT source, t_start, round(avg(value), 6) AS mean, count(value) AS n FROM w GROUP BY ALL""")
def sliding_windows(spark, d):
    from tidemark.streaming.windows import trend

    return trend(events(spark, d), "t", "value", 7200, ["source"], slide=3600).select("source", "t_start", r6("mean").alias("mean"), "n")


@query(f"{E}, k AS (SELECT DISTINCT source, CAST(round(t / 60) AS BIGINT) AS tick FROM e) SELECT source, count(*) AS ticks FROM k GROUP BY source")
def one_row_per_minute(spark, d):
    from tidemark.streaming.windows import one_per_tick

    return one_per_tick(events(spark, d), "t", ["source"], hz=1 / 60).groupBy("source").agg(F.count("*").alias("ticks"))


def stream_of_events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of the table's files."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return layout.with_epoch(raw, "ts", "t").select("t", F.col("event_type").alias("source"), F.col("user_id").alias("entity"), "event_id", "value")


@query(f"{E} SELECT source, CAST(floor(t / 3600) * 3600 AS BIGINT) AS t_start, round(avg(value), 6) AS mean, count(value) AS n FROM e GROUP BY 1, 2")
def streamed_windows(spark, d):
    from tidemark.streaming.windows import latest_updates, trend

    windows = trend(stream_of_events(spark, d), "t", "value", 3600, ["source"], late="400 days")
    return latest_updates(windows, ["source", "t_start"], scratch(spark, "stream")).select("source", "t_start", r6("mean").alias("mean"), "n")


# --- documents

@query(r"""WITH RECURSIVE p AS (SELECT item_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM benchmark),
s AS (SELECT item_id, list_filter(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM p),
r AS (SELECT item_id, l, 1 AS i, 0 AS page, length(l[1]) AS n FROM s WHERE len(l) > 0
 UNION ALL SELECT item_id, l, i + 1, CASE WHEN n + 1 + length(l[i + 1]) <= 800 THEN page ELSE page + 1 END, CASE WHEN n + 1 + length(l[i + 1]) <= 800 THEN n + 1 + length(l[i + 1]) ELSE length(l[i + 1]) END FROM r WHERE i < len(l))
SELECT item_id AS doc, CAST(page AS INTEGER) AS page, string_agg(l[i], ' ' ORDER BY i) AS text FROM r GROUP BY item_id, page""")
def doc_chunks(spark, d):
    return layout.chunks(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id", "text")

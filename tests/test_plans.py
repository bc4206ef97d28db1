"""Sources, stores, phrases, watches, the assistant, the command line, streams and the driver's entry."""

import calendar
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.operators import anomaly
from tidemark.plans import cli, documents, report, semantics, watching
from tidemark.plans.assistant import Assistant, in_scope, intent_of, mode_switch
from tidemark.plans.provider import Metered, Stub
from tidemark.plans.stores import Actors, Ambiguous, Knowledge, Watches
from tidemark.plans.timephrase import instant
from tidemark.sources import layout, sinks
from tidemark.streaming import windows

LO, HI = (float(calendar.timegm(d.timetuple())) for d in (dt.datetime(2026, 9, 1), dt.datetime(2026, 9, 5, 12, 2)))


@pytest.mark.parametrize(
    "phrase, want",
    [("on 2026-09-02 at 19:00", "2026-09-02 19:00"), ("2026-09-02", "2026-09-02 12:00"), ("on 2026-09-03 at 9am", "2026-09-03 09:00"), ("2 days ago at noon", "2026-09-03 12:00"), ("yesterday at 15:00", "2026-09-04 15:00"), ("frequency of x axis", None), ("what do you know", None), ("now", "2026-09-05 12:02"), ("3 hours ago", "2026-09-05 10:02"), ("on 1999-01-01", "2026-09-01 00:00")],
)
def test_phrases(phrase, want):
    found, note = instant(phrase, LO, HI, now=HI + 3600)
    assert (found and dt.datetime.fromtimestamp(found, dt.UTC).strftime("%Y-%m-%d %H:%M")) == want and note == ""


def test_phrases_on_old_data():
    found, note = instant("2 days ago", LO, HI, now=HI + 30 * 86400)
    assert dt.datetime.fromtimestamp(found, dt.UTC).day == 3 and "counted from there" in note and "2026-09-03" in note
    assert instant("on 2026-09-02", LO, HI, now=HI + 30 * 86400)[1] == ""


@pytest.fixture(scope="module")
def asset(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ship")
    rows = [(1756684800.0 + 60 * i, f"2026-09-0{1 + i // 200}", float(10 + (i // 100) % 2 * 20 + (i % 7)), float(i), 7.5) for i in range(800)]
    df = spark.createDataFrame(rows, "timestamp double, date string, rate double, counter double, flat double")
    sinks.write_partitioned(df, f"{root}/boat/engine/logs")
    track = spark.createDataFrame([(1756684800.0 + 60 * i, f"2026-09-0{1 + i // 200}", 50.0, 0.01 * i) for i in range(800)], "timestamp double, date string, latitude double, longitude double")
    sinks.write_partitioned(track, f"{root}/boat/position/logs")
    (root / "boat" / "empty").mkdir()
    (root / "boat" / "sources.yaml").write_text("asset_type: ferry\nplaces:\n  - {name: Alpha, lat: 50.0, lon: 1.0}\n  - {name: Beta, lat: 50.0, lon: 5.0}\n  - {name: Nowhere}\n")
    return str(root)


def test_layout(spark, asset):
    boat = layout.Layout(spark, asset, "boat")
    assert boat.sources() == ["engine", "position"] and boat.dates("engine") == [f"2026-09-0{d}" for d in (1, 2, 3, 4)] and boat.dates("none") == []
    assert boat.window("engine", days=2) == (["2026-09-03", "2026-09-04"], "2026-09-03..2026-09-04")
    assert boat.window("engine", start="2026-09-02", end="2026-09-02") == (["2026-09-02"], "2026-09-02")
    assert boat.window("engine", start="2027-01-01") == ([], "none") and boat.window("none") == (None, "none")
    day = boat.read("engine", ["2026-09-02"])
    assert day.count() == 200 and day.schema["date"].dataType.simpleString() == "string"
    assert "PartitionFilters: [" in day._jdf.queryExecution().toString() and "date" in day._jdf.queryExecution().toString().split("PartitionFilters: [")[1][:60]
    assert boat.asset_type() == "ferry" and [p["name"] for p in boat.places()] == ["Alpha", "Beta"]
    other = layout.Layout(spark, asset, "nobody")
    assert other.sources() == [] and other.metadata() == {} and other.asset_type() == "asset"


def test_widening(spark, tmp_path):
    spark.createDataFrame([(1.0, 1)], "timestamp double, x int").write.parquet(f"{tmp_path}/date=2026-01-01")
    spark.createDataFrame([(2.0, 2.5, "a")], "timestamp double, x double, y string").write.parquet(f"{tmp_path}/date=2026-01-02")
    rows = sorted(tuple(r) for r in layout.read_partitions(spark, str(tmp_path)).select("timestamp", "x", "y").collect())
    assert rows == [(1.0, 1.0, None), (2.0, 2.5, "a")]


def test_readers(spark, asset):
    table = layout.Table(spark, f"{asset}/boat/engine/logs")
    assert table.row_count() == 800 and table.scalar("max(counter)") == 799 and table.scalar("count(*)", "counter < 10") == 10
    assert table.query("SELECT count(*) AS n FROM {src} WHERE counter >= :least", least=790).first()["n"] == 10
    assert layout.epoch_text(0) == "1970-01-01 00:00:00"
    df = layout.numeric_with_time(table.df)
    assert df.columns == ["timestamp", "rate", "counter", "flat"] and layout.numeric(table.df, "counter < 5", ("flat",)).count() == 5
    zoneless = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS ts")
    assert layout.with_epoch(zoneless, "ts").first()["timestamp"] == 1704067200.0


def test_documents(spark, tmp_path):
    docs = spark.createDataFrame([("a", "One two three.  Four five six seven. " * 40), ("b", ""), ("c", None)], "doc string, text string")
    chunked = documents.index(docs, str(tmp_path / "index"), 100)
    rows = chunked.orderBy("page").collect()
    assert all(len(r["text"]) <= 100 and r["doc"] == "a" for r in rows) and [r["page"] for r in rows] == list(range(len(rows)))
    assert " ".join(r["text"] for r in rows) == " ".join(docs.first()["text"].split())
    top = layout.search(chunked, "fourFive_six", 2).collect()
    assert len(top) == 2 and top[0]["score"] >= top[1]["score"] > 0
    facts = documents.extract_facts(chunked, Stub({"One": '[{"fact": "The pump needs oil every week."}, {"fact": "Page 3"}, {"fact": "cut'}))
    assert facts == [{"fact": "The pump needs oil every week.", "citation": "a p. 0"}]


def test_stores(tmp_path):
    path = str(tmp_path / "k.json")
    k = Knowledge(path)
    k.add("document", "The pump is red.", citation="m p. 2")
    k.add("correction", "The pump is blue.")
    k.add("correction", "the pump is blue.")
    assert [r["text"] for r in k.tier("correction")] == ["The pump is blue."] and k.context().startswith("- [correction]")
    k.set_field("engine", "rate", unit="L/h", aggregation="integral")
    k.review(k.fields("engine")["rate"]["id"], True)
    assert k.set_field("engine", "rate", unit="rpm")["unit"] == "L/h"
    again = Knowledge(path)
    assert again.fields("engine")["rate"]["status"] == "confirmed" and again.context() == k.context()
    again.review(again.tier("document")[0]["id"], False)
    assert not again.tier("document")
    a = Actors()
    a.add("Ann Lee", roles=["captain"])
    a.add("Ann Moe")
    assert a.resolve("captain")["name"] == "Ann Lee" and a.resolve("ann moe")["name"] == "Ann Moe" and a.resolve("zed") is None
    with pytest.raises(Ambiguous):
        a.resolve("ann")
    w = Watches()
    one = w.add("engine", "threshold", {"signal": "rate"}, now=100.0)
    assert w.add("engine", "threshold", {"signal": "rate"}) is one and [x["id"] for x in w.due(100.0)] == [one["id"]]
    assert w.record(one["id"], "ok", 100.0) and not w.record(one["id"], "ok", 200.0) and w.due(300.0) == []
    w.set_enabled(one["id"], False)
    assert w.due(1e12) == [] and w.delete(one["id"]) and not w.delete(one["id"])
    with pytest.raises(ValueError):
        w.add("engine", "mood")


def test_watches(spark, asset, tmp_path):
    boat, log = layout.Layout(spark, asset, "boat"), str(tmp_path / "alerts.log")
    w = Watches()
    w.add("engine", "threshold", {"signal": "rate", "op": ">", "value": 5}, now=0.0, interval_s=10)
    w.add("missing", "threshold", {"signal": "rate", "value": 5}, now=0.0, interval_s=10)
    w.add("engine", "anomaly", now=0.0, interval_s=10)
    load = lambda x: boat.read(x["source"])
    first = watching.run_watches(w, load, lambda s: None, log, "boat", now=1.0)
    assert sorted(r["state"] for r in first) == ["breach:avg:rate:>:5", "error"]
    assert [r["state"] for r in watching.run_watches(w, load, lambda s: None, log, "boat", now=20.0)] == ["error"]
    with open(log) as f:
        assert [json.loads(line)["state"] for line in f] == ["breach:avg:rate:>:5"]
    assert not watching.holds(None, ">", 1) and watching.holds(2, "~", 1) and watching.recent_dates(["a", "b", "c"], {"dates": ["a", "b", "c"]}) == ["b", "c"]


def test_semantics():
    signals = ["EngineSpeed", "FuelTemperature", "EngineFuelRate", "sog"]
    assert semantics.resolve_signal("engine speed", signals) == "EngineSpeed" and semantics.resolve_signal("fuel", signals) is None
    assert semantics.resolve_signal("enginespede", signals) == "EngineSpeed"
    fields = {"sog": {"description": "speed over ground", "unit": "kn"}, "EngineSpeed": {"unit": "rpm"}, "x": {"role": "latitude"}}
    assert semantics.family("speed", signals, fields) and semantics.columns_by_role(["x", "lat"], fields, "latitude") == ["x"]
    assert semantics.columns_by_role(["pos_lat", "lon"], {}, "longitude") == ["lon"]
    assert semantics.salvage('x [{"field": "a"}, {"field": "b", "n": 1}, {"field": "c') == [{"field": "a"}, {"field": "b", "n": 1}]


@pytest.mark.parametrize("text, want", [("what can you do?", "capabilities"), ("average rate", "value"), ("trend of rate", "trend"), ("where are we", "position"), ("how far did we travel", "distance"), ("anything unusual?", "anomaly"), ("operating modes", "regimes"), ("show me legs", "voyage"), ("fuel per km", "efficiency"), ("ships nearby", "nearby"), ("hello", "smalltalk")])
def test_intents(text, want):
    assert intent_of(text, Stub()) == want


def test_scope_and_modes():
    assert in_scope("transport speed") and not in_scope("tell me a joke") and not in_scope("which movie?")
    assert mode_switch("operating modes in my data") is None and mode_switch("switch to expert") == "expert"


def test_assistant(spark, asset, tmp_path):
    boat = layout.Layout(spark, asset, "boat")
    knowledge = Knowledge()
    knowledge.set_field("engine", "rate", "confirmed", unit="L/h", aggregation="integral")
    meter = Metered(Stub())
    a = Assistant({s: boat.read(s) for s in boat.sources()}, meter, knowledge, artifacts=sinks.Artifacts(str(tmp_path), "boat"), places=boat.places())
    assert "rate" in a.send("what can you do?") and "flat (constant)" in a.send("capabilities of engine")
    assert a.send("total rate").startswith("integral of rate") and " L (" in a.send("total rate")
    assert a.send("maximum counter").startswith("max of counter: 799")
    assert "km travelled" in a.send("how far did we travel?")
    assert "km" in a.send("voyage from Alpha to Beta, fuel used?") and " L of rate" in a.send("voyage from Alpha to Beta, fuel used?")
    assert "L of rate per 20 km" in a.send("rate per 20 km")
    assert "100%" in a.send("coverage of engine")
    assert "Alpha to Beta" in a.send("distance between Alpha and Beta")
    assert "Watching" in a.send("watch rate above 5") and "threshold" in a.send("list watches")
    assert "on the list" in a.answer_actors("add Ann Lee as captain") and "captain" in a.send("who is the captain?")
    assert a.send("average").startswith("Which signal?") and a.send("counter").startswith("avg of counter")
    assert "asset's data" in a.send("tell me a joke")
    assert "no baseline" in a.send("anything unusual on engine?")
    assert "Noted" in a.send("actually, the pump is blue") and "regime" in a.send("operating modes of engine")
    assert "now for expert" in a.send("switch to expert") and meter.calls >= 0


def drifting(spark, tmp_path, provider=None):
    """An assistant over an engine whose signals part ways after the baseline's days, and a fleet with an idle boat."""
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.normal(size=600)
    rows = [(float(60 * i), "2026-09-01" if i < 300 else "2026-09-02", float(base[i]), float(base[i] + 0.05 * rng.normal()), float(rng.normal())) for i in range(600)]
    later = [(float(60 * i), "2026-09-05", float(rng.normal() + 3), float(rng.normal()), float(rng.normal())) for i in range(600, 900)]
    df = spark.createDataFrame(rows + later, "timestamp double, date string, load double, heat double, noise double")
    artifacts = sinks.Artifacts(str(tmp_path), "boat")
    made = anomaly.build_baseline(df.where("date < '2026-09-03'"), ["load", "heat", "noise"])
    assert made
    artifacts.save("baseline", "engine", made)
    stays = [(f"b{k}", 3600.0 * (10 * j + i), 50.0 + j, 0.01 * k) for k in (1, 2) for j in range(6) for i in range(3 if j < 5 or k == 1 else 9)]
    fleet = spark.createDataFrame(stays, "mmsi string, timestamp double, latitude double, longitude double")
    knowledge = Knowledge()
    knowledge.set_field("engine", "heat", "confirmed", description="coolant temperature")
    return Assistant({"fleet": fleet, "engine": df}, provider, knowledge, artifacts=artifacts)


def test_drift_in_chat(spark, tmp_path):
    a = drifting(spark, tmp_path)
    first = a.send("anything unusual?")  # only the engine has a baseline
    assert first.startswith("engine: ") and "changed" in first and "(300 rows)" in first and "Shall I show the details?" in first
    assert "These are departures, not causes." in a.send("yes please") and a.offered == []
    told = a.send("explain the drift on engine")
    assert "what caused it the data don't say" in told and ("coolant temperature" in told or "regime" in told)
    flags = a.send("anything unusual on fleet?")
    assert "no baseline" in flags and "fleet b2: the present stop lasts 8.0 h" in flags and "b1" not in flags

    class Teller(Stub):
        synthesizes = True

        def complete(self, system, user):
            return "told: " + user

    told = drifting(spark, tmp_path, Teller()).send("why this drift on engine?")
    grounds = json.loads(told.removeprefix("told: "))
    assert grounds["source"] == "engine" and grounds["rows"] == 300 and (grounds["ties"] or grounds["regimes"] or grounds["readings"])


def test_routing(spark, tmp_path):
    a = drifting(spark, tmp_path)
    assert a.source == "fleet" and a.route("value", "average heat") == "engine" and a.route("anomaly", "anything odd") == "engine"
    a.source = "engine"
    assert a.route("position", "where are we") == "fleet" and a.route("value", "mean of fleet") == "fleet" and a.route("value", "average") == "engine"


def test_interpretation(spark, tmp_path):
    from tidemark.plans import interpret

    edge = lambda a, b, d: {"scope": "global", "a": a, "b": b, "pearson": d, "dcor": d, "kind": "linear", "direct": True}
    edges = [edge("a", "b", 0.9), edge("a", "c", 0.5), edge("b", "c", 0.1), edge("d", "e", 0.3)]
    assert [(c["hub"], c["members"]) for c in interpret.clusters(edges)] == [("a", ["b", "c"]), ("b", ["a"]), ("c", ["a"]), ("d", ["e"]), ("e", ["d"])]
    made = interpret.interpret("engine", edges, Stub({"ties of a on": "a drives b"}))
    assert made[0]["reading"] == "a drives b" and made[0]["status"] == "guess" and made[1]["status"] == "none"
    knowledge = Knowledge()
    assert interpret.correct(made, "a", None)[0]["status"] == "confirmed" and interpret.correct(made, "a", "b drives a", knowledge)[0]["reading"] == "b drives a"
    assert "b drives a" in knowledge.context() or any("b drives a" in r["text"] for r in knowledge.tier("correction"))
    with pytest.raises(KeyError):
        interpret.correct(made, "z", None)
    a = drifting(spark, tmp_path)
    hub = a.interpretation("engine")[0]["hub"]
    assert a.apply_correction("engine", hub, "known")[0]["status"] == "corrected" and a.interpretation("engine")[0]["reading"] == "known"


def test_command_line(spark, asset, tmp_path, capsys):
    def run(*argv):
        code = cli.main(["--root", asset, "--asset", "boat", "--state", str(tmp_path), *argv], spark)
        return code, capsys.readouterr().out

    assert set(cli.parser()._subparsers._group_actions[0].choices) == set(cli.VERBS)
    assert json.loads(run("query", "engine", "counter", "--agg", "max")[1])["value"] == 799
    assert json.loads(run("query", "engine", "fuel_consumption", "--signal", "rate", "--days", "1")[1])["unit"] == "L"
    assert run("query", "engine", "fuel_consumption")[0] == 1 and run("detect", "engine")[0] == 1
    assert "flat: constant" in run("capabilities", "engine")[1]
    assert "# engine" in run("discover", "engine")[1] and "# engine" in run("report", "engine")[1]
    assert run("baseline", "engine")[0] == 0 and "departures" in run("detect", "engine")[1]
    assert run("plot", "engine", "rate", "--bucket", "hour")[1].count("\n") > 10
    assert run("watch", "add", "--source", "engine", "--params", '{"signal": "rate", "value": 1}')[0] == 0
    assert "breach" in run("watch", "run")[1] and "engine on" in run("watch", "list")[1]
    assert "km travelled" in run("ask", "how far did we travel?")[1]
    with pytest.raises(SystemExit):
        run("capabilities", "nothing")


def test_report():
    profiles = [{"label": 0, "size": 60, "fraction": 0.6, "a": 1.0, "b": 5.0}, {"label": 1, "size": 40, "fraction": 0.4, "a": 9.0, "b": 5.0}]
    edges = [{"scope": "global", "a": "a", "b": "b", "pearson": 0.9, "dcor": 0.92, "kind": "linear", "direct": False}]
    text = report.markdown(report.discovery_report("engine", {"k": 2, "model": {"silhouette": 0.8}, "profiles": profiles}, edges))
    assert "sharply separate" in text and "high a" in text and "through other signals" in text and "Hubs: a, b" in text


def test_streams(spark, tmp_path):
    zero = 36_000_000.0  # an hour; at the epoch itself the first watermark stands
    rows = [(zero + t, "x", 1.0 if t < 5000 else 2.0, 0.0) for t in range(0, 10000, 100)] + [(zero + 50000.0, "x", 9.0, 0.0)]
    df = spark.createDataFrame(rows, "t double, who string, lat double, lon double")
    df.write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).json(f"{tmp_path}/in")
    q = windows.stops(stream, "who").writeStream.format("memory").queryName("stops").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["t_start"] - zero, r["t_end"] - zero) for r in spark.table("stops").collect()) == [(0.0, 4900.0), (5000.0, 9900.0)]
    q = windows.trend(stream, "t", "lat", 3600, ["who"]).writeStream.format("memory").queryName("trend").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["t_start"] - zero: r["n"] for r in spark.table("trend").collect()}
    assert got[0] == 36 and got[3600] == 36
    spans = windows.sessions(df, "t", 1800, ["who"]).orderBy("t_start").collect()
    assert [(r["t_start"] - zero, r["t_end"] - zero, r["n"]) for r in spans] == [(0.0, 9900.0, 100), (50000.0, 50000.0, 1)]
    assert windows.one_per_tick(df, "t", ["who"], 0.001).count() == 12


def test_stream_state_ends(spark, tmp_path):
    """An entity that falls silent has its stop reported and its state dropped; fixes out of order are counted."""
    schema = "t double, who string, lat double, lon double"
    for k, rows in enumerate(([(float(t), "x", 1.0, 0.0) for t in range(1000, 6000, 100)], [(5000.0, "x", 1.0, 0.0), (6000.0, "x", 1.0, 0.0)], [(100_000.0, "y", 1.0, 0.0)], [(100_100.0, "y", 1.0, 0.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in{k}")
    import shutil

    (tmp_path / "in").mkdir()
    for k in range(4):
        part = next((tmp_path / f"in{k}").glob("*.json"))
        shutil.copy(part, tmp_path / "in" / f"{k}.json")
        import os

        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = windows.stops(stream, "who", late="1 hour", idle="1 hour").writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", f"{tmp_path}/c3").trigger(availableNow=True).start()
    q.awaitTermination(180)
    rows = spark.table("silent").collect()
    assert [(r["entity"], r["t_start"], r["t_end"]) for r in rows if r["ended"] == "silent"] == [("x", 1000.0, 6000.0)]
    assert sum(r["late"] for r in rows) == 1


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and {"integral_total", "stops", "asof_rows"} <= names


def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("events", "lineitem", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    from tidemark.plans.queries import ORACLES, QUERIES

    plain = lambda rows: sorted(repr([round(float(v), 6) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, int) else v for v in r]) for r in rows)
    for name in ("integral_by_source", "trend_4h", "asof_rows", "nearby_entities", "coverage_gaps", "stops", "transitions", "distance_segments", "voyage_window"):
        df, sql = QUERIES[name](spark, folder), c.sql(ORACLES[name])
        columns = sorted(df.columns)
        assert columns == sorted(sql.columns), name
        assert plain(tuple(r) for r in df.select(*columns).collect()) == plain(sql.select(", ".join(f'"{x}"' for x in columns)).fetchall()), name
    assert F is not None


@pytest.mark.parametrize("stops", [0, 1, 2, 3])
def test_dwell_flag_has_a_row_for_few_stops(spark, tmp_path, stops):
    duckdb = pytest.importorskip("duckdb")
    from tidemark.plans.queries import ORACLES, QUERIES

    rows = [(50 * i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for i in range(5)]  # each elsewhere
    rows += [(50 * (5 + k) + j, dt.datetime(2024, 1, 2 + k) + dt.timedelta(minutes=(20 + k) * j)) for k in range(stops) for j in range(3)]
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    c.sql("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    c.executemany("INSERT INTO events VALUES (?, ?, 1, 'click', 1.0, NULL)", rows)
    c.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df, want = QUERIES["dwell_flag"](spark, str(tmp_path)), c.sql(ORACLES["dwell_flag"])
    assert df.columns == want.columns
    assert [tuple(r) for r in df.collect()] == want.fetchall()

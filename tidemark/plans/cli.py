"""The command line: ``python -m tidemark.plans.cli VERB ...``."""

from __future__ import annotations

import argparse
import json
import sys
import time

from tidemark.functions.expr import bucket_seconds
from tidemark.operators import aggregates, anomaly, discovery, timejoin
from tidemark.plans import documents, report, semantics, watching
from tidemark.plans.assistant import Assistant
from tidemark.plans.provider import provider
from tidemark.plans.stores import Knowledge, Watches
from tidemark.sources.layout import Layout, search
from tidemark.sources.sinks import Artifacts

VERBS = ("discover", "fused", "baseline", "detect", "report", "interpret", "ingest-docs", "review-docs", "describe-fields", "plot", "capabilities", "query", "chat", "ask", "correct", "watch")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--root", default="ship-data")
    p.add_argument("--asset", default="vessel-001")
    p.add_argument("--state", default=".tidemark")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *positional: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        for a in positional:
            v.add_argument(a)
        v.add_argument("--days", type=int)
        v.add_argument("--from", dest="start")
        v.add_argument("--to", dest="end")
        return v

    for name in ("discover", "baseline", "detect", "report", "interpret", "describe-fields", "capabilities"):
        verb(name, "source")
    verb("fused").add_argument("sources", nargs="*")
    verb("ingest-docs", "path")
    review = verb("review-docs")
    review.add_argument("--accept", nargs="*", default=[])
    review.add_argument("--reject", nargs="*", default=[])
    review.add_argument("--search")
    plot = verb("plot", "source", "signal")
    plot.add_argument("--kind", choices=("trend", "timeseries", "scatter"), default="trend")
    plot.add_argument("--against")
    plot.add_argument("--bucket", default="hour")
    query = verb("query", "source", "metric")
    query.add_argument("--agg", default="avg")
    query.add_argument("--unit", default="")
    query.add_argument("--signal")
    verb("chat").add_argument("--mode", default="general")
    verb("ask", "question")
    verb("correct", "text")
    watch = verb("watch")
    watch.add_argument("action", choices=("add", "list", "run", "delete", "enable", "disable"))
    watch.add_argument("--id")
    watch.add_argument("--source")
    watch.add_argument("--type", default="threshold")
    watch.add_argument("--params", default="{}")
    watch.add_argument("--interval", type=int, default=3600)
    watch.add_argument("--loop", action="store_true")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    layout, artifacts = Layout(spark, a.root, a.asset), Artifacts(a.state, a.asset)
    knowledge, watches = Knowledge(f"{a.state}/knowledge_{a.asset}.json"), Watches(f"{a.state}/watches_{a.asset}.json")

    def rows(source: str):
        dates, label = layout.window(source, a.days, a.start, a.end)
        if not dates:
            raise SystemExit(f"{source}: no data" if dates is None else f"{source}: no date in that window")
        return layout.read(source, dates), label

    def found(source: str) -> dict:
        df, _ = rows(source)
        made = discovery.regime_graphs(df, aggregates.numeric_columns(df))
        made["edges"] = [r.asDict() for r in made["edges"].collect()]
        artifacts.save("discovery", source, made)
        return made

    def helper() -> Assistant:
        return Assistant({s: layout.read(s) for s in layout.sources()}, provider(), knowledge, None, watches, artifacts, layout.places(), getattr(a, "mode", "general"))

    if a.verb in ("discover", "report", "interpret"):
        made = found(a.source) if a.verb == "discover" else artifacts.load("discovery", a.source) or found(a.source)
        print(report.markdown(report.discovery_report(a.source, made, made["edges"])))
        if a.verb == "interpret" and (p := provider()).synthesizes:
            print(p.complete("Say what these ties may mean. Invent no numbers.\n" + knowledge.context(), json.dumps(made["edges"][:40])))
    elif a.verb == "fused":
        sources = a.sources or layout.sources()
        graph = discovery.fused_graph(timejoin.fuse({s: rows(s)[0] for s in sources}))
        edges = [r.asDict() for r in graph["edges"].collect()]
        artifacts.save("discovery", "fused", {k: v for k, v in graph.items() if k != "edges"} | {"edges": edges})
        cross = sorted((e for e in edges if e["cross"] and e["dcor"] >= discovery.LEAST_DCOR), key=lambda e: -e["dcor"])
        print("\n".join(report.edge_words(e) for e in cross[:15]) or "No ties across sources.")
    elif a.verb == "baseline":
        df, label = rows(a.source)
        base = anomaly.build_baseline(df, aggregates.numeric_columns(df))
        if not base:
            print("too little data for a baseline")
            return 1
        print(f"baseline over {label}: {artifacts.save('baseline', a.source, base)}")
    elif a.verb == "detect":
        base = artifacts.load("baseline", a.source)
        if not base:
            print("no baseline")
            return 1
        if not (a.days or a.start or a.end):
            df = layout.read(a.source, watching.recent_dates(layout.dates(a.source), base))
        else:
            df, _ = rows(a.source)
        print(anomaly.render_drift(anomaly.detect_drift(df, base)))
    elif a.verb == "ingest-docs":
        chunked = documents.index(documents.load_texts(spark, a.path), f"{a.state}/documents_{a.asset}")
        facts = documents.extract_facts(chunked, provider())
        for f in facts:
            knowledge.add("document", f["fact"], author="document", citation=f["citation"])
        print(f"{chunked.count()} chunks, {len(facts)} facts to review")
    elif a.verb == "review-docs":
        for key, accept in [*((k, True) for k in a.accept), *((k, False) for k in a.reject)]:
            knowledge.review(key, accept)
        if a.search:
            for r in search(spark.read.parquet(f"{a.state}/documents_{a.asset}"), a.search).collect():
                print(f"{r['doc']} p. {r['page']} ({r['score']:.2f}): {r['text'][:160]}")
        for r in knowledge.tier("document"):
            print(f"{r['id']} {r['text']} ({r['citation']})")
    elif a.verb == "describe-fields":
        df, _ = rows(a.source)
        semantics.describe_fields(df.columns, provider(), knowledge, a.source)
        for f, k in sorted(knowledge.fields(a.source).items()):
            print(f"{f}: {k.get('description', '')} [{k.get('unit', '')}] {k.get('role', '')} {k['status']}")
    elif a.verb == "plot":
        df, _ = rows(a.source)
        if a.kind == "scatter":
            print(json.dumps(aggregates.scatter(df, a.signal, a.against).first().asDict()))
            series = report.scatter_series(df, a.signal, a.against)
        elif a.kind == "timeseries":
            series = report.time_series(df, a.signal)
        else:
            series = aggregates.series(df, a.signal, bucket_seconds(a.bucket)).orderBy("bucket")
        for r in series.toLocalIterator():
            print(*r, sep="\t")
    elif a.verb == "capabilities":
        for r in aggregates.capabilities(rows(a.source)[0]).collect():
            print(f"{r['signal']}: " + (f"{r['min']:g} to {r['max']:g}" if r["usable"] else r["reason"]))
    elif a.verb == "query":
        df, label = rows(a.source)
        if a.metric == "fuel_consumption":
            rate = [a.signal] if a.signal else semantics.rates(knowledge.fields(a.source))
            if len(rate) != 1:
                print(f"name the rate with --signal: {', '.join(rate) or 'none is known'}")
                return 1
            r = aggregates.fuel_consumption(df, rate[0], a.unit or knowledge.fields(a.source).get(rate[0], {}).get("unit", "L/h"), label).first()
        else:
            r = aggregates.aggregate(df, a.metric, a.agg, a.unit, label).first()
        print(json.dumps(r.asDict()))
    elif a.verb == "ask":
        print(helper().send(a.question))
    elif a.verb == "chat":
        who = helper()
        for line in sys.stdin:
            print(who.send(line.strip()), flush=True)
    elif a.verb == "correct":
        print(knowledge.add("correction", a.text)["id"])
    elif a.verb == "watch":
        return _watch(a, layout, artifacts, watches)
    return 0


def _watch(a, layout, artifacts, watches) -> int:
    if a.action == "add":
        print(watches.add(a.source, a.type, json.loads(a.params), a.interval)["id"])
    elif a.action == "list":
        for w in watches.all():
            print(w["id"], w["condition_type"], w["source"], "on" if w["enabled"] else "off", w["last_state"])
    elif a.action == "delete":
        return 0 if watches.delete(a.id) else 1
    elif a.action in ("enable", "disable"):
        return 0 if watches.set_enabled(a.id, a.action == "enable") else 1
    else:
        while True:
            base = lambda s: artifacts.load("baseline", s)

            def load(w):
                dates = layout.dates(w["source"])
                days = w["params"].get("days")
                return layout.read(w["source"], watching.recent_dates(dates, base(w["source"])) if w["condition_type"] != "threshold" else dates[-int(days) :] if days else dates)

            for alert in watching.run_watches(watches, load, base, f"{a.state}/alerts.log", a.asset):
                print(json.dumps(alert))
            if not a.loop:
                break
            time.sleep(30)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Words for numbers, reports, and the series behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import aggregates


def strength(dcor: float) -> str:
    return next(word for least, word in ((0.8, "very strong"), (0.6, "strong"), (0.4, "moderate"), (0.15, "weak"), (-1.0, "no")) if dcor >= least)


def separation(silhouette: float) -> str:
    return next(word for least, word in ((0.7, "sharply separate"), (0.5, "clearly separate"), (0.35, "loosely separate"), (-2.0, "blurred")) if silhouette >= least)


def pretty(name: str) -> str:
    return name.replace("__", " / ").replace("_", " ")


def edge_words(edge: dict) -> str:
    kind = {"linear": "in a straight line", "nonlinear": "along a curve", "none": "not at all"}[edge["kind"]]
    via = "" if edge.get("direct") in (None, True) else ", through other signals"
    return f"{pretty(edge['a'])} and {pretty(edge['b'])}: {strength(edge['dcor'])} tie, {kind}{via} (dCor {edge['dcor']:.2f})"


def regime_words(profiles: list[dict], label: int, top: int = 3) -> str:
    """What sets a regime apart: the signals whose means differ most from the others', by the spread of all regimes' means."""
    own = next(p for p in profiles if p["label"] == label)
    names = [c for c in own if c not in ("label", "size", "fraction")]
    scores = []
    total = sum(p["size"] for p in profiles) or 1
    for c in names:
        some = [(p[c], p["size"]) for p in profiles if p.get(c) is not None]
        mean = sum(v * n for v, n in some) / total
        spread = (sum(n * (v - mean) ** 2 for v, n in some) / total) ** 0.5
        if spread:
            scores.append(((own[c] - mean) / spread, c))
    lead = sorted(scores, key=lambda s: -abs(s[0]))[:top]
    return f"regime {label} ({own['fraction']:.0%}): " + ", ".join(f"{'high' if z > 0 else 'low'} {pretty(c)}" for z, c in lead)


def discovery_report(source: str, found: dict, edges: list[dict], top: int = 8) -> dict:
    """A report of regimes and ties as data; ``markdown`` renders it."""
    model = found.get("model") or {}
    strong = sorted((e for e in edges if e["dcor"] >= 0.15), key=lambda e: -e["dcor"])
    hubs: dict[str, float] = {}
    for e in strong:
        if e["scope"] in ("global", "fused"):
            for c in (e["a"], e["b"]):
                hubs[c] = hubs.get(c, 0.0) + e["dcor"]
    scopes = sorted({e["scope"] for e in strong})
    return {
        "source": source,
        "k": found.get("k", 0),
        "separation": separation(model["silhouette"]) if model else "none",
        "regimes": [regime_words(found["profiles"], p["label"]) for p in found.get("profiles", []) if p["size"]],
        "edges": {s: [edge_words(e) for e in strong if e["scope"] == s][:top] for s in scopes},
        "kinds": {s: {k: sum(1 for e in strong if e["scope"] == s and e["kind"] == k) for k in ("linear", "nonlinear")} for s in scopes},
        "hubs": sorted(hubs, key=lambda c: (-hubs[c], c))[:5],
        "note": found.get("note", ""),
    }


def markdown(report: dict) -> str:
    lines = [f"# {report['source']}", "", f"{report['k']} operating regimes, {report['separation']}." if report["k"] else report["note"], ""]
    lines += [f"- {r}" for r in report["regimes"]]
    for scope, edges in report["edges"].items():
        lines += ["", f"## {scope}", "", *[f"- {e}" for e in edges]]
    if report["hubs"]:
        lines += ["", "Hubs: " + ", ".join(pretty(h) for h in report["hubs"])]
    return "\n".join(lines) + "\n"


# --- the series behind the four kinds of chart; drawing them is left to whatever draws

def scatter_series(df: DataFrame, x: str, y: str, most: int = 5000) -> DataFrame:
    """At most ``most`` points, by a hash: a chart's worth. Its statistics (``aggregates.scatter``) are over all rows."""
    points = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    return aggregates.sample_rows(points, most, [F.col("x"), F.col("y")])


def time_series(df: DataFrame, signal: str, time: str = "timestamp", most: int = 2000) -> DataFrame:
    """Readings in time, thinned to about ``most`` by taking every n-th."""
    rows = df.select(F.col(time).cast("double").alias("t"), F.col(signal).cast("double").alias("value")).dropna()
    return aggregates.decimate(rows, "t", most)


def distance_series(segments: DataFrame, value: str = "value") -> DataFrame:
    """Bars along a track: km_start, km_end, value."""
    return segments.select("km_start", "km_end", F.col(value).alias("value")).where("value is not null")

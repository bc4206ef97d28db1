"""Departures from a known-good baseline: dependence, regimes, their sequence, joint values, periods."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.functions.expr import period, quoted
from tidemark.operators import discovery
from tidemark.operators.ordered import with_neighbour
from tidemark.sources.scratch import written

BAND, BAND_P90, FLOOR = 0.08, 0.12, 0.05
RARE, EXPECTED, RELIABLE = 0.05, 0.20, 8
SHIFT = 0.15
LEAST_ROWS = 50


# --- sequence of regimes

def runs(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows (t, label) at which the label changes, the first included."""
    rows = with_neighbour(labels, "t", ["label"], by, ["label"])
    return rows.where(F.col("prev_label").isNull() | (F.col("prev_label") != F.col("label"))).select(*(by or []), "t", "label")


def transitions(labels: DataFrame) -> DataFrame:
    """from_label, to_label, cnt, prob (of the source's departures, four places)."""
    steps = with_neighbour(runs(labels), "t", ["label"], tie=["label"]).where("prev_label is not null")
    counts = steps.groupBy(F.col("prev_label").alias("from_label"), F.col("label").alias("to_label")).agg(F.count("*").alias("cnt"))
    return counts.withColumn("prob", F.round(F.col("cnt") / F.sum("cnt").over(Window.partitionBy("from_label")), 4))


def transition_findings(base: DataFrame, window: DataFrame) -> DataFrame:
    """unseen (not in the baseline), absent (likely there, missing here though the source was left often enough) and rare transitions.

    Columns kind, from_label, to_label, base_prob, window_prob, cnt, confidence, delta; unseen first, then absent, then rare, by |delta|."""
    leave = window.groupBy("from_label").agg(F.sum("cnt").alias("leave"))
    b = base.select("from_label", "to_label", F.col("prob").alias("base_prob"))
    w = window.select("from_label", "to_label", F.col("prob").alias("window_prob"), "cnt")
    both = b.join(w, ["from_label", "to_label"], "full_outer").join(leave, "from_label", "left")
    kind = F.when(F.col("base_prob").isNull(), "unseen").when(F.col("window_prob").isNull() & (F.col("base_prob") >= EXPECTED) & (F.col("leave") >= 1), "absent").when(F.col("window_prob").isNotNull() & (F.col("base_prob") < RARE), "rare")
    rows = both.withColumn("kind", kind).where("kind is not null")
    rows = rows.withColumn("delta", F.round(F.coalesce("window_prob", F.lit(0.0)) - F.coalesce("base_prob", F.lit(0.0)), 4))
    rows = rows.withColumn("reliable", F.coalesce("leave", F.lit(0)) >= RELIABLE).withColumn("confidence", F.when(F.col("leave") >= 40, "high").when(F.col("leave") >= 15, "medium").otherwise("low"))
    return rows.select("kind", "from_label", "to_label", F.coalesce("base_prob", F.lit(0.0)).alias("base_prob"), F.coalesce("window_prob", F.lit(0.0)).alias("window_prob"), F.coalesce("cnt", F.lit(0)).alias("cnt"), "reliable", "confidence", "delta")


# --- dependence structure

def fingerprint(edges: DataFrame) -> DataFrame:
    """scope, edge (names in order, joined by ::), dcor of edges strong enough to count."""
    key = F.concat_ws("::", F.array_sort(F.array("a", "b")))
    return edges.where((F.col("dcor") >= discovery.LEAST_DCOR) & (F.col("scope") != "global")).select("scope", key.alias("edge"), "dcor")


def variation_band(daily: DataFrame) -> dict:
    """From (date, scope, edge, dcor): {std: by (scope, edge), median, p90} of the deviations over days (two at least); defaults where there are none."""
    per = daily.groupBy("scope", "edge").agg(F.stddev_pop("dcor").alias("std"), F.count("*").alias("n")).where("n >= 2")
    both = per.agg(F.median("std").alias("m"), F.percentile("std", 0.9).alias("p")).first()
    return {"std": {(r["scope"], r["edge"]): r["std"] for r in per.collect()}, "median": BAND if both["m"] is None else both["m"], "p90": BAND_P90 if both["p"] is None else both["p"]}


def fingerprint_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the mean |difference| of dcor over the edges of the scopes that both have (missing counts 0), four places."""
    shared = a.select("scope").distinct().join(b.select("scope").distinct(), "scope")
    x = a.join(shared, "scope").select("scope", "edge", F.col("dcor").alias("x"))
    y = b.join(shared, "scope").select("scope", "edge", F.col("dcor").alias("y"))
    diff = x.join(y, ["scope", "edge"], "full_outer").select(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))).alias("d"))
    return diff.agg(F.round(F.coalesce(F.avg("d"), F.lit(0.0)), 4).alias("distance"))


def structure_drift(base: DataFrame, window: DataFrame, band: DataFrame, default_std: float = BAND_P90, rows: int = 5000) -> DataFrame:
    """Edges whose dcor left the band: scope, edge, base, window, delta, kind, threshold (three places), confidence.

    ``band``: scope, edge, std. The threshold is three deviations, 0.05 at least."""
    b, w = base.select("scope", "edge", F.col("dcor").alias("base")), window.select("scope", "edge", F.col("dcor").alias("window"))
    both = b.join(w, ["scope", "edge"], "full_outer").join(band.select("scope", "edge", "std"), ["scope", "edge"], "left")
    both = both.withColumn("base", F.coalesce("base", F.lit(0.0))).withColumn("window", F.coalesce("window", F.lit(0.0)))
    both = both.withColumn("delta", F.round(F.col("window") - F.col("base"), 4)).withColumn("threshold", F.greatest(F.coalesce("std", F.lit(default_std)) * 3, F.lit(FLOOR)))
    kind = F.when(F.col("base") == 0, "appeared").when(F.col("window") == 0, "disappeared").when(F.col("delta") < 0, "weakened").otherwise("strengthened")
    return both.where(F.abs("delta") > F.col("threshold")).select("scope", "edge", "base", "window", "delta", kind.alias("kind"), F.round("threshold", 3).alias("threshold"), F.lit("high" if rows >= 5000 else "medium" if rows >= 1000 else "low").alias("confidence"))


def regime_events(base: DataFrame, window: DataFrame) -> DataFrame:
    """New, vanished and shifted regimes by their fractions (label, fraction), over the labels of either."""
    both = base.select("label", F.col("fraction").alias("b")).join(window.select("label", F.col("fraction").alias("w")), "label", "full_outer")
    b, w = F.coalesce("b", F.lit(0.0)), F.coalesce("w", F.lit(0.0))
    kind = F.when((b == 0) & (w > 0), "new_regime").when(F.abs(w - b) >= SHIFT, "distribution_shift")
    return both.select("label", b.alias("base_fraction"), w.alias("window_fraction"), kind.alias("kind")).where("kind is not null")


def match_regimes(base: list[dict], window: list[dict], cutoff: float = 2.5) -> dict[int, int]:
    """Window label to base label, greedily by relative centroid distance, one to one and within the cutoff."""
    def distance(p: dict, q: dict) -> float:
        shared = sorted(set(p["centroid"]) & set(q["centroid"]))
        if not shared:
            return float("inf")
        return float(np.sqrt(sum(((p["centroid"][c] - q["centroid"][c]) / (abs(p["centroid"][c]) or 1.0)) ** 2 for c in shared)))

    options = sorted((distance(p, q), q["label"], p["label"]) for p in base for q in window)
    found: dict[int, int] = {}
    for d, w, b in options:
        if d <= cutoff and w not in found and b not in found.values():
            found[w] = b
    return found


# --- joint values

def monotonic_columns(df: DataFrame, columns: list[str], time: str = "timestamp") -> list[str]:
    """Columns of which 98 % of the changes, in time order, have one sign (three readings at least)."""
    rows = df.select(F.col(time).alias("t"), *[quoted(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    names = [f"v{i}" for i in range(len(columns))]
    rows = with_neighbour(rows, "t", names, tie=names)
    one = rows.agg(*[f for i in range(len(columns)) for f in (F.count_if(F.col(f"v{i}") > F.col(f"prev_v{i}")).alias(f"u{i}"), F.count_if(F.col(f"v{i}") < F.col(f"prev_v{i}")).alias(f"d{i}"), F.count(f"v{i}").alias(f"n{i}"))]).first()
    return [c for i, c in enumerate(columns) if one[f"n{i}"] >= 3 and one[f"u{i}"] + one[f"d{i}"] and max(one[f"u{i}"], one[f"d{i}"]) / (one[f"u{i}"] + one[f"d{i}"]) >= 0.98]


def distance_column(columns: list[str], mean: list[float], inverse: list[list[float]]) -> Column:
    """The squared Mahalanobis distance as an expression; a missing value counts as the mean."""
    d = [F.coalesce(F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double")), F.lit(float(m))) - F.lit(float(m)) for c, m in zip(columns, mean, strict=True)]
    total = F.lit(0.0)
    for i, x in enumerate(d):
        for j, y in enumerate(d):
            total = total + x * y * F.lit(float(inverse[i][j]))
    return total


def contribution_columns(columns: list[str], mean: list[float], inverse: list[list[float]]) -> Column:
    """Each column's share of the squared distance, as an array of (signal, share); nulls where the distance is 0."""
    d = [F.coalesce(quoted(c).cast("double"), F.lit(float(m))) - F.lit(float(m)) for c, m in zip(columns, mean, strict=True)]
    total = distance_column(columns, mean, inverse)
    parts = []
    for i, c in enumerate(columns):
        own = F.lit(0.0)
        for j, y in enumerate(d):
            own = own + y * F.lit(float(inverse[i][j]))
        parts.append(F.struct(F.lit(c).alias("signal"), F.when(total > 0, d[i] * own / total).alias("share")))
    return F.array(*parts)


def fit_envelope(df: DataFrame, columns: list[str], ridge: float = 1e-3, q: float = 0.999) -> dict | None:
    """{columns, mean, inverse, threshold, n} of scaled rows: all moments from one pass, the threshold from the larger of the chi-square and the observed quantile. None below 50 rows."""
    rows = df.dropna(subset=columns)
    x = [quoted(c).cast("double") for c in columns]
    one = rows.agg(F.count("*").alias("n"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]).first()
    if one["n"] < LEAST_ROWS:
        return None
    mean = [one[f"m{i}"] for i in range(len(x))]
    cov = np.array([[one[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(x))] for i in range(len(x))])
    # the ridge is on the scale of each column
    scale = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
    inverse = (np.linalg.inv(cov / np.outer(scale, scale) + ridge * np.eye(len(x))) / np.outer(scale, scale)).tolist()
    seen = rows.agg(F.percentile_approx(distance_column(columns, mean, inverse), q, 100_000).alias("q")).first()["q"]
    return {"columns": columns, "mean": mean, "inverse": inverse, "threshold": max(kernels.chi2_quantile(q, len(columns)), seen), "n": one["n"]}


def build_envelopes(labelled: DataFrame, columns: list[str], time: str = "timestamp") -> dict[int, dict]:
    """An envelope per label, without columns that only count up (unless that leaves none)."""
    counting = set(monotonic_columns(labelled, columns, time))
    kept = [c for c in columns if c not in counting] or columns
    labels = [r[0] for r in labelled.select("label").distinct().collect()]
    found = {k: fit_envelope(labelled.where(F.col("label") == k), kept) for k in sorted(labels)}
    return {k: e for k, e in found.items() if e}


def detect_joint(labelled: DataFrame, envelopes: dict[int, dict]) -> DataFrame:
    """Per label with an envelope: n, flagged, fraction (four places), and the mean shares of the signals over flagged rows."""
    found = None
    for k, e in envelopes.items():
        d = distance_column(e["columns"], e["mean"], e["inverse"])
        rows = labelled.where(F.col("label") == k).withColumn("_d", d).withColumn("_c", contribution_columns(e["columns"], e["mean"], e["inverse"]))
        hit = F.col("_d") > e["threshold"]
        part = rows.agg(F.lit(k).alias("label"), F.count("*").alias("n"), F.count_if(hit).alias("flagged"), *[F.avg(F.when(hit, F.get("_c", F.lit(i))["share"])).alias(f"s{i}") for i in range(len(e["columns"]))])
        top = F.slice(F.reverse(F.array_sort(F.array(*[F.struct(F.col(f"s{i}").alias("share"), F.lit(c).alias("signal")) for i, c in enumerate(e["columns"])]))), 1, 4)
        part = part.select("label", "n", "flagged", F.round(F.try_divide("flagged", "n"), 4).alias("fraction"), top.alias("top"))
        found = part if found is None else found.unionByName(part)
    return found


def train_autoencoders(labelled: DataFrame, columns: list[str], most: int = 5000, q: float = 0.999) -> dict[int, tuple]:
    """Per label with 200 rows or more, a small network trained on a capped sample, and the error that q of all the label's rows stay under."""
    nets = {}
    for k in sorted(r[0] for r in labelled.select("label").distinct().collect()):
        data = discovery.sampled(labelled.where(F.col("label") == k).dropna(subset=columns), columns, most)
        if len(data) >= 200:
            nets[k] = (kernels.Autoencoder(len(columns)).fit(data), float("inf"))
    if not nets:
        return {}
    limits = autoencoder_errors(labelled, columns, nets).groupBy("label").agg(F.percentile_approx("error", q, 100_000).alias("q")).collect()
    return {r["label"]: (nets[r["label"]][0], r["q"]) for r in limits}


def autoencoder_errors(labelled: DataFrame, columns: list[str], models: dict[int, tuple]) -> DataFrame:
    """label, error, flagged per row that has all columns and whose label has a network."""
    sent = labelled.sparkSession.sparkContext.broadcast(models)

    def run(frames):
        for f in frames:
            for k, part in f.groupby("label"):
                if k in sent.value and len(part):
                    net, limit = sent.value[k]
                    e = net.errors(part[columns].to_numpy(float))
                    yield part[["label"]].assign(error=e, flagged=e > limit)

    return labelled.dropna(subset=columns).select("label", *columns).mapInPandas(run, "label int, error double, flagged boolean")


# --- periods

def classify_periods(steps: list[float], total: list[float], jump: float = 2.5, floor: float = 0.08) -> str:
    """stable, sudden_break, slow_drift or insufficient_history, from the distance of each period to the one before and to the first."""
    if not steps:
        return "insufficient_history"
    middle = sorted(steps)[len(steps) // 2]
    if max(steps) > max(jump * middle, floor):
        return "sudden_break"
    return "slow_drift" if total and total[-1] >= floor else "stable"


def group_dates(dates: list[str], granularity: str = "month") -> dict[str, list[str]]:
    size = {"day": 10, "month": 7, "year": 4}[granularity]
    out: dict[str, list[str]] = {}
    for d in sorted(dates):
        out.setdefault(d[:size], []).append(d)
    return out


def daily_fingerprints(df: DataFrame, columns: list[str], model: dict, date: str = "date", granularity: str = "day", seed: int = 0) -> DataFrame:
    """date, scope, edge, dcor of each period and regime with enough rows: all periods in one plan, a group each.

    A group's dependence is measured on at most the sample cap of its rows, chosen by a hash of the whole row before the groups are formed."""
    known = df.dropna(subset=columns).withColumn("_u", F.pmod(F.xxhash64(F.lit(seed), *[quoted(c) for c in df.columns]), F.lit(1 << 20)) / float(1 << 20))
    rows = written(discovery.assign_labels(known, model).select(period(F.col(date), granularity).alias("date"), "label", "_u", *[quoted(c).cast("double").alias(c) for c in columns]), "daily")
    cap = sample_cap = discovery.sample_cap(len(columns))
    sizes = rows.groupBy("date", "label").agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST_ROWS)
    rows = rows.join(sizes, ["date", "label"])
    rows = rows.where(F.col("_u") * F.col("_n") < sample_cap).drop("_u", "_n")

    def measure(key, frame):
        import pandas as pd

        data = frame[columns].to_numpy(float)[:cap]
        use = [i for i in range(len(columns)) if data[:, i].std() > 0]
        found = discovery.pair_rows(data, columns, [(i, j) for a, i in enumerate(use) for j in use[a + 1 :]], None, False, 0, seed)
        return pd.DataFrame([(str(key[0]), f"regime {key[1]}", "::".join(sorted((r[0], r[1]))), r[3]) for r in found if r[3] >= discovery.LEAST_DCOR], columns=["date", "scope", "edge", "dcor"])

    return rows.groupBy("date", "label").applyInPandas(measure, "date string, scope string, edge string, dcor double")


def multiscale_drift(daily: DataFrame) -> dict:
    """Steps between consecutive periods and from the first, and what they amount to; ``daily`` as by ``daily_fingerprints``."""
    table: dict[str, dict] = {}
    for r in daily.collect():  # one row per period, regime and edge
        table.setdefault(r["date"], {})[(r["scope"], r["edge"])] = r["dcor"]
    keys = sorted(table)

    def apart(a: dict, b: dict) -> float:
        shared = {s for s, _ in a} & {s for s, _ in b}
        edges = [e for e in {*a, *b} if e[0] in shared]
        return round(float(np.mean([abs(a.get(e, 0.0) - b.get(e, 0.0)) for e in edges])), 4) if edges else 0.0

    steps = [apart(table[a], table[b]) for a, b in zip(keys, keys[1:], strict=False)]
    total = [apart(table[keys[0]], table[k]) for k in keys[1:]]
    return {"periods": keys, "steps": steps, "cumulative": total, "classification": classify_periods(steps, total)}


# --- baseline and detection

def build_baseline(df: DataFrame, columns: list[str], time: str = "timestamp", date: str = "date", seed: int = 0) -> dict:
    """What a known-good stretch looks like: regime model, profiles, fingerprint, band over its days, transitions, envelopes. Empty if there is too little."""
    found = discovery.regime_graphs(df, columns, seed=seed)
    model = found["model"]
    if model is None:
        return {}
    kept = model["columns"]
    labelled = discovery.labelled_once(df.dropna(subset=kept), model, [time, *kept])
    daily = daily_fingerprints(df, kept, model, date, seed=seed)
    band = variation_band(daily)
    moves = transitions(labelled.select(F.col(time).alias("t"), "label"))
    return {
        "model": model,
        "profiles": found["profiles"],
        "fingerprint": [r.asDict() for r in fingerprint(found["edges"]).collect()],
        "band": {"std": [{"scope": s, "edge": e, "std": v} for (s, e), v in band["std"].items()], "median": band["median"], "p90": band["p90"]},
        "transitions": [r.asDict() for r in moves.collect()],
        "envelopes": {str(k): e for k, e in build_envelopes(labelled, kept, time).items()},
        "dates": sorted(r[0] for r in df.select(F.col(date).cast("string")).distinct().collect()),
    }


def detect_drift(df: DataFrame, baseline: dict, time: str = "timestamp", seed: int = 0, use_ae: DataFrame | None = None) -> dict:
    """A window against a baseline, under the baseline's regime model: structure, regimes, transitions, joint values; an autoencoder trained on ``use_ae`` if given."""
    spark, model = df.sparkSession, baseline["model"]
    kept = [c for c in model["columns"] if c in df.columns]
    found = discovery.regime_graphs(df, kept, model=model, seed=seed)
    table = lambda rows, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    edge = "scope string, edge string, dcor double"
    base, band = table(baseline["fingerprint"], edge), table(baseline["band"]["std"], "scope string, edge string, std double")
    n = sum(p["size"] for p in found["profiles"])
    drift = structure_drift(base, fingerprint(found["edges"]), band, baseline["band"]["p90"], n)
    fractions = "label int, fraction double"
    events = regime_events(table(baseline["profiles"], fractions), table(found["profiles"], fractions))
    labelled = discovery.labelled_once(df.dropna(subset=kept), model, [time, *kept])
    moves = transitions(labelled.select(F.col(time).alias("t"), "label"))
    was = table(baseline["transitions"], "from_label int, to_label int, cnt long, prob double")
    joint = detect_joint(labelled, {int(k): e for k, e in baseline["envelopes"].items()}) if baseline["envelopes"] else None
    out = {
        "rows": n,
        "structure": sorted((r.asDict() for r in drift.collect()), key=lambda r: -abs(r["delta"])),
        "regimes": [r.asDict() for r in events.collect()],
        "transitions": [r.asDict() for r in transition_findings(was, moves).collect()],
        "joint": [r.asDict(True) for r in joint.collect()] if joint is not None else [],
    }
    if use_ae is not None:
        nets = train_autoencoders(discovery.assign_labels(use_ae.dropna(subset=kept), model), kept)
        rows = autoencoder_errors(labelled, kept, nets)
        out["autoencoder"] = [r.asDict() for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("flagged").alias("flagged")).collect()]
    return out


def render_drift(result: dict) -> str:
    """A report in words; it says what changed and never why."""
    lines = [f"{result['rows']} rows compared with the baseline."]
    for r in result["structure"][:8]:
        lines.append(f"- {r['scope']}: {r['edge'].replace('::', ' ~ ')} {r['kind']} ({r['base']:.2f} to {r['window']:.2f}; {r['confidence']} confidence)")
    for r in result["regimes"][:6]:
        lines.append(f"- regime {r['label']}: {r['kind'].replace('_', ' ')} ({r['base_fraction']:.0%} to {r['window_fraction']:.0%})")
    for r in result["transitions"][:6]:
        lines.append(f"- {r['kind']} change of regime {r['from_label']} to {r['to_label']}")
    for r in result["joint"][:6]:
        if r["flagged"]:
            lines.append(f"- regime {r['label']}: {r['fraction']:.2%} of readings are jointly unusual, led by {r['top'][0]['signal']}")
    if len(lines) == 1:
        lines.append("Nothing departs from it.")
    return "\n".join([*lines, "These are departures, not causes."])

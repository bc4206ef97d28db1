"""Operating regimes, and the dependence between signals inside each.

Whole-table figures (means, deviations, labels, profiles) are DataFrame plans. Dependence measures run on a
bounded sample drawn by a hash (that cap is the operator's own), in parallel over pairs of columns."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import kernels
from tidemark.functions.expr import quoted
from tidemark.operators.aggregates import clean_columns
from tidemark.sources.scratch import written

LEAST_DCOR, LINEAR, EXTRA = 0.15, 0.5, 0.2
INDUCED_PARTIAL, INDUCED_DROP = 0.1, 0.15
LEAST_ROWS, K_RANGE, CLUSTER_SAMPLE = 50, (2, 6), 5000
EDGES = "scope string, a string, b string, pearson double, dcor double, mi double, partial double, direct boolean, kind string, pvalue double, significant boolean"


def sample_cap(columns: int) -> int:
    """Rows on which dependence is measured, by the number of columns."""
    return 10_000 if columns <= 15 else 5_000 if columns <= 30 else 2_500


def classify(pearson: float, dcor: float) -> str:
    if dcor < LEAST_DCOR:
        return "none"
    return "linear" if pearson > LINEAR or dcor - pearson <= EXTRA else "nonlinear"


def classify_column(pearson: Column, dcor: Column) -> Column:
    return F.when(dcor < LEAST_DCOR, "none").when((pearson > LINEAR) | (dcor - pearson <= EXTRA), "linear").otherwise("nonlinear")


def is_direct(pearson: float, partial: float | None) -> bool | None:
    """False for a tie that the other columns explain."""
    return None if partial is None else not (partial < INDUCED_PARTIAL and pearson - partial > INDUCED_DROP)


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, pearson (absolute; 0 where undefined) of all pairs of columns in one pass over all rows."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(quoted(a).cast("double"), quoted(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.nanvl(F.abs(F.col(f"r{i}")), F.lit(0.0)), F.lit(0.0)).alias("pearson")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def sampled(df: DataFrame, columns: list[str], most: int, seed: int = 0, order: str | None = None) -> np.ndarray:
    """At most ``most`` rows as a matrix: the least by a hash of the row, in the order of ``order`` if given. Two actions; bounded."""
    values = [quoted(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]
    key = F.col(order).cast("double") if order else F.lit(0.0)
    rows = df.select(key.alias("o"), *values)
    n = rows.count()
    if n > most:
        rows = rows.withColumn("h", F.xxhash64(F.lit(seed), *rows.columns)).orderBy("h", *rows.columns).limit(most).drop("h")
    found = rows.toPandas().sort_values(["o"], kind="stable")
    return found.drop(columns="o").to_numpy(float).reshape(-1, len(columns))


def pair_rows(data: np.ndarray, columns: list[str], pairs: list[tuple[int, int]], partial, with_mi: bool, n_perm: int, seed: int) -> list[tuple]:
    out = []
    for i, j in pairs:
        x, y = data[:, i], data[:, j]
        pearson, dcor = kernels.pearson_abs(x, y), kernels.distance_correlation(x, y)
        part = None if partial is None else float(partial[i, j])
        p = kernels.block_pvalue(x, y, dcor, n_perm, seed=seed) if n_perm and dcor >= LEAST_DCOR else None
        mi = kernels.mutual_information(x, y, seed=seed) if with_mi else None
        out.append((columns[i], columns[j], round(pearson, 4), round(dcor, 4), mi, None if part is None else round(part, 4), is_direct(pearson, part), classify(pearson, dcor), p, None if p is None else p <= 0.05))
    return out


def pairwise_dependence(spark, columns: list[str], data: np.ndarray, scope: str = "global", with_mi: bool = False, n_perm: int = 0, seed: int = 0) -> DataFrame:
    """The dependence of every pair of columns of a bounded matrix; pairs are dealt to tasks, the matrix is broadcast (its size is capped)."""
    pairs = list(combinations(range(len(columns)), 2))
    if not pairs:
        return spark.createDataFrame([], EDGES)
    partial = kernels.partial_correlation_matrix(data)
    sent = spark.sparkContext.broadcast((np.ascontiguousarray(data), partial))
    tasks = min(len(pairs), max(1, spark.sparkContext.defaultParallelism))

    def run(batches):
        import pyarrow as pa

        held, part = sent.value
        for b in batches:
            rows = pair_rows(held, columns, list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), part, with_mi, n_perm, seed)
            names = ["a", "b", "pearson", "dcor", "mi", "partial", "direct", "kind", "pvalue", "significant"]
            kinds = [pa.string(), pa.string(), *[pa.float64()] * 4, pa.bool_(), pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([scope] * len(rows), pa.string()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["scope", *names])

    found = spark.createDataFrame(pairs, "i int, j int").repartition(tasks, "i", "j").mapInArrow(run, EDGES)
    peak = max((r[0] or 0 for r in found.agg(F.max("mi")).collect()), default=0) if with_mi else 0
    return found.withColumn("mi", F.col("mi") / peak) if peak else found


def build_graph(df: DataFrame, columns: list[str], scope: str = "global", with_mi: bool = False, n_perm: int = 0, seed: int = 0, time: str | None = None) -> DataFrame:
    """Edges among columns worth a look, strongest measure and all; keep those with ``dcor >= LEAST_DCOR`` for a report.

    With significance the sample is kept in time order, as blocks of time are what is permuted."""
    kept, clean = clean_columns(df, columns)
    if len(kept) < 2:
        return df.sparkSession.createDataFrame([], EDGES)
    data = sampled(clean, kept, sample_cap(len(kept)), seed, time if n_perm else None)
    return pairwise_dependence(df.sparkSession, kept, data, scope, with_mi, n_perm, seed)


def segment_regimes(df: DataFrame, columns: list[str], k_range: tuple[int, int] = K_RANGE, most: int = CLUSTER_SAMPLE, seed: int = 0) -> dict | None:
    """The regime model {columns, mean, scale, centres, k, silhouette}: scales from all rows, clusters from a capped sample, k by silhouette.

    None where there is nothing to cluster (no columns, too few or identical rows)."""
    if not columns:
        return None
    one = df.agg(*[f(quoted(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if one["m0"] is None:
        return None
    mean = np.array([one[f"m{i}"] for i in range(len(columns))])
    scale = np.array([one[f"s{i}"] or 1.0 for i in range(len(columns))])
    z = (sampled(df.dropna(subset=columns), columns, most, seed) - mean) / scale
    best = None
    for k in range(k_range[0], k_range[1] + 1):
        if len(np.unique(z, axis=0)) <= k:
            break
        centres, label, _ = kernels.kmeans(z, k, seed)
        score = kernels.silhouette(z, label)
        if best is None or score > best[0]:
            best = (score, centres)
    if best is None:
        return None
    return {"columns": list(columns), "mean": mean.tolist(), "scale": scale.tolist(), "centres": best[1].tolist(), "k": len(best[1]), "silhouette": round(best[0], 4)}


def assign_labels(df: DataFrame, model: dict, out: str = "label") -> DataFrame:
    """The rows with the number of the nearest centre, the first of equals. Columns or values that are missing count as the model's mean. No shuffle."""
    have = set(df.columns)
    scaled = []
    for c, m, s in zip(model["columns"], model["mean"], model["scale"], strict=True):
        x = F.coalesce(F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double")), F.lit(float(m))) if c in have else F.lit(float(m))
        scaled.append((x - F.lit(float(m))) / F.lit(float(s) or 1.0))
    rows = df.withColumn("_z", F.array(*scaled))
    distances = []
    for centre in model["centres"]:
        total = F.lit(0.0)
        for i, c in enumerate(centre):
            total = total + F.pow(F.get("_z", F.lit(i)) - F.lit(float(c)), F.lit(2.0))
        distances.append(total)
    rows = rows.withColumn("_d", F.array(*distances))
    return rows.withColumn(out, (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_z", "_d")


def labelled_once(df: DataFrame, model: dict, columns: list[str]) -> DataFrame:
    """The named columns and ``label``, written: labels cost more than all that is then asked of the rows of each."""
    return written(assign_labels(df, model).select(*[quoted(c) for c in dict.fromkeys(columns)], "label"), "labelled")


def label_sequence(df: DataFrame, model: dict, time: str = "timestamp") -> DataFrame:
    """t and label of rows with at least one of the model's signals."""
    present = [c for c in model["columns"] if c in df.columns]
    some = F.greatest(*[F.col(f"`{c}`").isNotNull().cast("int") for c in present], F.lit(0)) if present else F.lit(0)
    return assign_labels(df.where(some == 1), model).select(F.col(time).cast("double").alias("t"), "label")


def regime_profiles(labelled: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """Per label: size, fraction (four places) and the mean of each column, largest first by size."""
    sums = labelled.groupBy(label).agg(F.count("*").alias("size"), *[F.avg(quoted(c).cast("double")).alias(c) for c in columns])
    total = sums.agg(F.sum("size").alias("_total"))
    return sums.join(F.broadcast(total)).withColumn("fraction", F.round(F.col("size") / F.col("_total"), 4)).drop("_total")


def centroid_spread(profiles: DataFrame, columns: list[str]) -> DataFrame:
    """Per signal the mean and deviation of the regimes' means, each weighted by its regime's size: signal, mean, spread."""
    x = [quoted(c) for c in columns]
    n = F.sum("size")
    one = profiles.agg(*[f for i, v in enumerate(x) for f in ((F.sum(v * F.col("size")) / n).alias(f"m{i}"), F.sqrt(F.greatest(F.sum(v * v * F.col("size")) / n - F.pow(F.sum(v * F.col("size")) / n, F.lit(2.0)), F.lit(0.0))).alias(f"s{i}"))])
    rows = [F.struct(F.lit(c).alias("signal"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("spread")) for i, c in enumerate(columns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def regime_graphs(df: DataFrame, columns: list[str], model: dict | None = None, with_mi: bool = False, n_perm: int = 0, seed: int = 0, time: str | None = None) -> dict:
    """Regimes and a graph per regime with enough rows, under a given model or a new one: {k, model, profiles, edges, note}."""
    spark = df.sparkSession
    kept, clean = clean_columns(df, columns)
    n = clean.count() if kept else 0
    if n < LEAST_ROWS:
        return {"k": 0, "model": None, "profiles": [], "edges": spark.createDataFrame([], EDGES), "note": f"{n} usable rows; {LEAST_ROWS} are needed"}
    model = model or segment_regimes(clean, kept, seed=seed)
    edges = build_graph(clean, kept, "global", with_mi, n_perm, seed, time)
    if model is None:
        return {"k": 1, "model": None, "profiles": [], "edges": edges, "note": "one regime"}
    labelled = labelled_once(clean, model, [*kept, *([time] if time and n_perm else [])])
    profiles = {r["label"]: r.asDict() for r in regime_profiles(labelled, kept).collect()}
    for k in range(model["k"]):
        profiles.setdefault(k, {"label": k, "size": 0, "fraction": 0.0})
        if profiles[k]["size"] >= LEAST_ROWS:
            edges = edges.unionByName(build_graph(labelled.where(F.col("label") == k).drop("label"), kept, f"regime {k}", with_mi, n_perm, seed, time))
    return {"k": model["k"], "model": model, "profiles": sorted(profiles.values(), key=lambda p: (-p["size"], p["label"])), "edges": edges, "note": ""}


def cross_source(a: Column, b: Column) -> Column:
    """Whether two fused columns come from different sources."""
    return F.split(a, "__")[0] != F.split(b, "__")[0]


def fused_graph(fused: DataFrame, seed: int = 0) -> dict:
    """A graph over fused columns: edges with ``cross`` set where they tie two sources, and how distinct the regimes are (blurred below 0.35)."""
    columns = [c for c in fused.columns if c != "tg"]
    kept, clean = clean_columns(fused, columns)
    model = segment_regimes(clean, kept, seed=seed)
    score = model["silhouette"] if model else 0.0
    edges = build_graph(clean, kept, "fused", seed=seed).withColumn("cross", cross_source(F.col("a"), F.col("b")))
    return {"edges": edges, "silhouette": score, "blurred": score < 0.35, "model": model}

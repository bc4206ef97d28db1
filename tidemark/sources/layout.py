"""Assets, sources and date partitions on any file system that Spark reads.

Layout: ``<root>/<asset>/<source>/logs/date=YYYY-MM-DD/*.parquet`` and ``<root>/<asset>/sources.yaml``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, NumericType, TimestampNTZType, TimestampType

from tidemark.functions.expr import quoted, wall_seconds


def _listing(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what a folder holds; empty if there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p)] if fs.exists(p) else []


class Layout:
    """Where an asset's sources are."""

    def __init__(self, spark: SparkSession, root: str, asset: str = "vessel-001"):
        self.spark, self.root, self.asset = spark, root.rstrip("/"), asset

    @property
    def base(self) -> str:
        return f"{self.root}/{self.asset}"

    def logs(self, source: str) -> str:
        return f"{self.base}/{source}/logs"

    def sources(self) -> list[str]:
        """Folders that hold Parquet at any depth."""
        return sorted(n for n, folder in _listing(self.spark, self.base) if folder and self._holds(f"{self.base}/{n}"))

    def _holds(self, path: str) -> bool:
        return any(self._holds(f"{path}/{n}") if folder else n.endswith(".parquet") for n, folder in _listing(self.spark, path))

    def dates(self, source: str) -> list[str]:
        """Partitions in order; empty without a folder."""
        return sorted(n.removeprefix("date=") for n, folder in _listing(self.spark, self.logs(source)) if folder and n.startswith("date="))

    def window(self, source: str, days: int | None = None, start: str | None = None, end: str | None = None) -> tuple[list[str] | None, str]:
        """Dates and a label: the last ``days`` available ones (that wins), else those within start and end, else all.

        (None, 'none') without data, ([], 'none') if none match."""
        have = self.dates(source)
        if not have:
            return None, "none"
        if days:
            some = have[-days:]
        else:
            some = [d for d in have if (not start or d >= start) and (not end or d <= end)]
        if not some:
            return [], "none"
        return some, some[0] if len(some) == 1 else f"{some[0]}..{some[-1]}"

    def read(self, source: str, dates: list[str] | None = None) -> DataFrame:
        """A source's rows with ``date`` as a string; only the partitions of the dates are read."""
        return read_partitions(self.spark, self.logs(source), dates)

    def metadata(self) -> dict:
        """``sources.yaml``, or an empty dict."""
        import yaml

        path = f"{self.base}/sources.yaml"
        if not any(n == "sources.yaml" for n, _ in _listing(self.spark, self.base)):
            return {}
        return yaml.safe_load(self.spark.read.text(path, wholetext=True).first()[0]) or {}

    def places(self) -> list[dict]:
        """Known places that have a name and coordinates."""
        return [p for p in self.metadata().get("places") or [] if p.get("name") and p.get("lat") is not None and p.get("lon") is not None]

    def asset_type(self) -> str:
        return self.metadata().get("asset_type") or "asset"


def read_partitions(spark: SparkSession, path: str, dates: list[str] | None = None) -> DataFrame:
    """Parquet under date partitions, columns united by name; a column of several numeric types is widened to double."""
    reader = spark.read.option("basePath", path).option("mergeSchema", "true")
    try:
        df = reader.parquet(path)
    except Exception as clash:
        if "CANNOT_MERGE" not in str(clash):
            raise
        days = [n for n, folder in _listing(spark, path) if folder and n.startswith("date=") and (dates is None or n[5:] in dates)]
        df = unite([spark.read.option("basePath", path).parquet(f"{path}/{d}") for d in days])
    if "date" in df.columns:
        if dates is not None:
            df = df.where(F.col("date").isin([__import__("datetime").date.fromisoformat(d) for d in dates] if isinstance(df.schema["date"].dataType, DateType) else dates))
        df = df.withColumn("date", F.col("date").cast("string"))
    return df


def unite(frames: list[DataFrame]) -> DataFrame:
    """A union by name; missing columns are null, and numeric columns of unlike types become double."""
    kinds: dict[str, set] = {}
    for f in frames:
        for field in f.schema.fields:
            kinds.setdefault(field.name, set()).add(field.dataType)
    wide = {c for c, k in kinds.items() if len(k) > 1 and all(isinstance(t, NumericType) for t in k)}
    whole = {c for c in wide if all(isinstance(t, IntegralType) for t in kinds[c])}
    cast = lambda f: f.select(*[(quoted(c).cast("long" if c in whole else "double").alias(c) if c in wide else quoted(c)) for c in f.columns])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(cast, frames))


def with_epoch(df: DataFrame, column: str, out: str = "timestamp") -> DataFrame:
    """The rows with a time column as seconds since 1970: zoneless times are read as UTC, numbers as seconds."""
    kind = df.schema[column].dataType
    x = quoted(column)
    seconds = wall_seconds(x) if isinstance(kind, TimestampNTZType) else F.unix_micros(x) / F.lit(1e6) if isinstance(kind, TimestampType) else x.cast("double")
    return df.withColumn(out, seconds)


def signals_of(df: DataFrame, time: str = "timestamp") -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != time]


def numeric(df: DataFrame, where: str | None = None, exclude: tuple[str, ...] = (), time: str = "timestamp") -> DataFrame:
    """The numeric columns but the time, as doubles."""
    rows = df.where(where) if where else df
    return rows.select(*[quoted(c).cast("double").alias(c) for c in signals_of(df, time) if c not in exclude])


def numeric_with_time(df: DataFrame, where: str | None = None, exclude: tuple[str, ...] = (), time: str = "timestamp") -> DataFrame:
    """The numeric columns in time order, the time first if there is one."""
    rows = df.where(where) if where else df
    names = [quoted(c).cast("double").alias(c) for c in signals_of(df, time) if c not in exclude]
    return rows.orderBy(time).select(F.col(time).cast("double"), *names) if time in df.columns else rows.select(*names)


def time_range(df: DataFrame, time: str = "timestamp") -> DataFrame:
    return df.agg(F.min(time).alias("t_min"), F.max(time).alias("t_max"))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.approx_count_distinct(quoted(column)).alias("distinct"))


class Table:
    """One Parquet table behind SQL: ``{src}`` in a statement stands for it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.df = spark, spark.read.parquet(path)

    def columns(self) -> list[str]:
        return self.df.columns

    def row_count(self) -> int:
        return self.df.count()

    def scalar(self, expression: str, where: str | None = None):
        rows = self.df.where(where) if where else self.df
        return rows.selectExpr(f"{expression} AS value").first()[0]

    def query(self, sql: str, **args) -> DataFrame:
        return self.spark.sql(sql, src=self.df, args=args or None)


def epoch_text(seconds) -> str:
    """UTC time of an epoch, to the second."""
    import datetime

    return datetime.datetime.fromtimestamp(float(seconds), datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")


def chunks(docs: DataFrame, doc: str, text: str, size: int = 800) -> DataFrame:
    """Texts cut into chunks of whole sentences, about ``size`` characters each: doc, page (from 0), text.

    White space is collapsed; sentences are packed greedily in order; a sentence longer than a chunk is one by itself. Empty texts have none."""
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    sentences = F.filter(F.split(plain, r"(?<=[.!?]) "), lambda s: s != "")
    start = F.array().cast("array<string>")

    def add(done, s):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(" "), s)))
        return F.when(F.size(done) == 0, F.array(s)).when(F.length(last) + 1 + F.length(s) <= size, grown).otherwise(F.concat(done, F.array(s)))

    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.aggregate(sentences, start, add)).alias("page", "text"))


def search(chunked: DataFrame, query: str, k: int = 4) -> DataFrame:
    """The k chunks that share most words with a query: doc, page, text, score = shared / (sqrt(words of the query) sqrt(words of the chunk)). Top-k report."""
    from tidemark.functions.expr import tokens

    rows = chunked.withColumn("_t", tokens(F.col("text"))).withColumn("_q", tokens(F.lit(query)))
    score = F.size(F.array_intersect("_t", "_q")) / (F.sqrt(F.size("_t")) * F.sqrt(F.size("_q")))
    return rows.where(F.arrays_overlap("_t", "_q")).select("doc", "page", "text", score.alias("score")).orderBy(F.desc("score"), "doc", "page").limit(k)

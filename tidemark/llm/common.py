"""What the operators of this subpackage share: column picking, shared scratch tables, hashes of rows."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them: runs of anything but these six characters.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python gets at most so many rows at a time: ten thousand texts, the default, are tens of megabytes in each of several copies."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else the table has.

    Names are matched exactly first and without case second, by position, so that further columns
    called alike (even ``TEXT`` beside ``text``) do no harm. A missing column is a KeyError."""
    have = df.columns
    at = []
    for name in names:
        same = [i for i, c in enumerate(have) if c == name] or [i for i, c in enumerate(have) if c.lower() == name.lower()]
        if not same:
            raise KeyError(f"no column {name!r} among {have}")
        at.append(same[0])
    plain = df.toDF(*[f"_c{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names, strict=True)])


class Carried:
    """A table under column names that cannot clash with any an operator adds.

    ``frame`` has the columns ``_c0``, ``_c1``, ...; ``at(name)`` gives the one that stands for a name;
    ``back(df)`` picks them again under the names the table came with."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.frame = df.toDF(*[f"_c{i}" for i in range(len(self.names))])

    def at(self, name: str) -> str:
        same = [i for i, c in enumerate(self.names) if c == name] or [i for i, c in enumerate(self.names) if c.lower() == name.lower()]
        if not same:
            raise KeyError(f"no column {name!r} among {self.names}")
        return f"_c{same[0]}"

    def back(self, df: DataFrame) -> DataFrame:
        return df.select(*[f"_c{i}" for i in range(len(self.names))]).toDF(*self.names)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidemark-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes the tables this application has written to the shared folder; their DataFrames can't be read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Actions in here drop their shuffles' files as they end, and not whenever the driver collects garbage. (An action that fails for want of them runs its stages again.)"""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def batches_within(spark: SparkSession, size: int) -> Iterator[None]:
    """Actions in here hand rows to Python in batches that end at so many bytes, however few rows that is: of large rows each comes alone."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The table, written to the shared folder and read again: lineage ends here and lost executors cost no rerun. What it was shuffled
    through is deleted."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with passing_shuffles(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Deletes a table that ``written`` made and nothing reads any more."""
    for file in table.inputFiles()[:1]:
        folder = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def by_salt(left: DataFrame, right: DataFrame, on: list[str], salt: list[str], salts: int = 64) -> DataFrame:
    """Inner join with a table that has each key once, when a key may have any share of the left rows.

    The left rows of a key are dealt over ``salts`` by a hash of the columns ``salt``; the right ones are repeated only under salts that occur."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*salt, F.lit(5)), F.lit(salts)).cast("int"))
    there = dealt.select(*on, "_salt").distinct()
    return dealt.join(there.join(right, on), [*on, "_salt"]).drop("_salt")


def with_least(rows: DataFrame, key: str, value: str, out: str, salts: int = 64) -> DataFrame:
    """The rows with a column ``out``: the least ``value`` of their key, summed and joined by salt, as a key may have any share of the rows."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(value, F.lit(5)), F.lit(salts)).cast("int"))
    parts = dealt.groupBy(key, "_salt").agg(F.min(value).alias("_least"))
    least = parts.groupBy(key).agg(F.min("_least").alias(out))
    return dealt.join(parts.select(key, "_salt").join(least, key), [key, "_salt"]).drop("_salt")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != F.lit(""))


def column_bytes(batch, name: str) -> list:
    """A string column of an Arrow batch as Python bytes, None where null."""
    import pyarrow as pa

    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def column_list(batch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def lean(run: Callable) -> Callable:
    """A function over batches that gives memory back to the system when a task ends: workers stay, and what they have freed counts as theirs."""

    def runs(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return runs


def release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def as_batch(schema, **columns):
    """An Arrow batch with the columns in the schema's order."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def batches_of(items: Iterator, most: int) -> Iterator[list]:
    """Lists of up to ``most`` items each."""
    some: list = []
    for x in items:
        some.append(x)
        if len(some) >= most:
            yield some
            some = []
    if some:
        yield some

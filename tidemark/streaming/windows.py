"""Windows, sessions, deduplication and stops over streams; batch frames go through the same functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.trajectory import StopScan


def _stamped(df: DataFrame, time: str, late: str | None) -> DataFrame:
    rows = df.withColumn("_ts", F.timestamp_micros((F.col(time) * 1e6).cast("long")))
    return rows.withWatermark("_ts", late) if late and df.isStreaming else rows


def trend(df: DataFrame, time: str, value: str, seconds: int, by: list[str] | None = None, slide: int | None = None, late: str | None = "10 minutes", nearest: bool = False) -> DataFrame:
    """by, t_start, mean, n per tumbling (or sliding) window; ``nearest`` centres windows on multiples of their size, as batch trends do."""
    size, step = f"{seconds} seconds", f"{slide or seconds} seconds"
    window = F.window("_ts", size, step, f"{seconds / 2:g} seconds") if nearest else F.window("_ts", size, step)
    rows = _stamped(df, time, late).groupBy(window.alias("w"), *(by or [])).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return rows.select(*(by or []), F.unix_seconds("w.start").alias("t_start"), "mean", "n")


def sessions(df: DataFrame, time: str, gap_seconds: int, by: list[str] | None = None, late: str | None = "10 minutes") -> DataFrame:
    """by, t_start, t_end, n of stretches without a gap of ``gap_seconds`` or more."""
    rows = _stamped(df, time, late).groupBy(F.session_window("_ts", f"{gap_seconds} seconds").alias("w"), *(by or []))
    return rows.agg(F.min(time).alias("t_start"), F.max(time).alias("t_end"), F.count("*").alias("n")).select(*(by or []), "t_start", "t_end", "n")


def one_per_tick(df: DataFrame, time: str, by: list[str], hz: float = 10.0, late: str = "10 minutes") -> DataFrame:
    """The first row to arrive of each grid tick and key; state is dropped behind the watermark."""
    rows = _stamped(df, time, late).withColumn("_tick", F.round(F.col(time) * hz).cast("long"))
    made = rows.dropDuplicatesWithinWatermark([*by, "_tick"]) if df.isStreaming else rows.dropDuplicates([*by, "_tick"])
    return made.drop("_ts", "_tick")


def latest_updates(stream: DataFrame, keys: list[str], path: str) -> DataFrame:
    """What a stream of updates comes to once it has read all that is there: per key the row of the last batch that changed it.

    Batches are written under ``path``, with the stream's checkpoint; a batch that runs again replaces its own rows."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")


def stops(df: DataFrame, entity: str, move_km: float = 1.0, least_s: float = 1800.0, late: str = "10 minutes", idle: str = "7 days") -> DataFrame:
    """Stops of each entity of a stream of fixes (t, lat, lon), reported as they end. State is one anchor per entity.

    Columns: entity, t_start, t_end, lat, lon, duration_s, ended ('moved', or 'silent' where the entity was not heard of for ``idle`` of event time and
    its anchor is dropped), late (fixes left out in that batch, as they came behind the last one seen; a row of its own, with
    ``ended`` null, if there is no stop to carry it)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    columns = ["entity", "t_start", "t_end", "lat", "lon", "duration_s", "ended", "late"]
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scan = StopScan(move_km, least_s)
        if state.exists:
            t, lat, lon, scan.last = state.get
            scan.anchor = (t, lat, lon)
        if state.hasTimedOut:
            out = [(str(key[0]), *s[:5], "silent", 0) for s in scan.finish()]
            state.remove()
            yield pd.DataFrame(out, columns=columns)
            return
        f, behind = pd.concat(list(frames)).sort_values("t"), 0  # what one entity sent in one batch
        if scan.anchor:
            behind = int((f["t"] < scan.last).sum())
            f = f[f["t"] >= scan.last]
        found = list(scan.feed(f["t"].to_numpy(), f["lat"].to_numpy(), f["lon"].to_numpy()))
        if scan.anchor:
            state.update((*scan.anchor, scan.last))
            state.setTimeoutTimestamp(max(int(scan.last * 1000) + wait, state.getCurrentWatermarkMs() + 1))
        out = [(str(key[0]), *s[:5], "moved", behind if i == 0 else 0) for i, s in enumerate(found)]
        if behind and not out:
            out = [(str(key[0]), None, None, None, None, None, None, behind)]
        yield pd.DataFrame(out, columns=columns)

    rows = _stamped(df.select(F.col(entity).cast("string").alias("entity"), "t", "lat", "lon").dropna(), "t", late)
    schema = "entity string, t_start double, t_end double, lat double, lon double, duration_s double, ended string, late long"
    return rows.groupBy("entity").applyInPandasWithState(step, schema, "t double, lat double, lon double, last double", "append", GroupStateTimeout.EventTimeTimeout)

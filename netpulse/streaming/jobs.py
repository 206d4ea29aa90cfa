"""Structured Streaming forms of the roll-up, dedup, landing and alarm jobs.

Event time is the UTC instant as TIMESTAMP (a watermark needs one). Local hours
and days of a half-hour zone are windows with a start offset. Aggregates are
sums, counts and extremes, which combine before the shuffle, so the ``all`` row
of a window is cheap however many hosts report.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netpulse.functions import exact, timeparts
from netpulse.operators import oplogs, quality, rollup
from netpulse.plans import jobs
from netpulse.schemas import EVENTS
from netpulse.sinks import tables as sinks
from netpulse.sources.normalize import is_valid

GRACE = "10 minutes"
# Fixed values for UTC+5:30: window length and the offset of local boundaries.
WINDOWS = {
    "hourly": ("1 hour", "30 minutes"),
    "daily": ("1 day", "18 hours 30 minutes"),
    "weekly": ("7 days", "3 days 18 hours 30 minutes"),
}


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table replayed as a stream."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def with_event_time(rows: DataFrame, grace: str = GRACE) -> DataFrame:
    return rows.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", grace)


def windowed_rollup(measurements: DataFrame, level: str) -> DataFrame:
    """Tumbling local hours or days per host and for ``all``; a closed window is emitted once."""
    length, offset = WINDOWS[level]
    flagged = with_event_time(measurements).select(
        "event_time",
        F.explode(F.array("host_id", F.lit("all"))).alias("host_id"),
        is_valid().alias("ok"),
        *[F.when(is_valid(), F.col(c)).alias(c) for c in rollup.METRICS.values()],
    )
    stats: list[Column] = [
        F.count_if("ok").alias("records"),
        F.count_if(~F.col("ok")).alias("errors"),
    ]
    for c in rollup.METRICS.values():
        stats += [F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n")]
        stats += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    grouped = flagged.groupBy(F.window("event_time", length, startTime=offset).alias("w"), "host_id").agg(*stats)
    shown = [
        F.col("host_id"),
        timeparts.to_local(F.col("w.start")).alias("period"),
        F.col("records"),
        F.col("errors"),
    ]
    for metric, c in rollup.METRICS.items():
        mean = exact.mean_hundredths(F.col(f"{c}_sum"), F.col(f"{c}_n"))
        shown += [
            exact.from_hundredths(mean).alias(f"{metric}_avg"),
            exact.from_hundredths(F.col(f"{c}_min")).alias(f"{metric}_min"),
            exact.from_hundredths(F.col(f"{c}_max")).alias(f"{metric}_max"),
        ]
    return grouped.select(*shown).where("records > 0")


# Windows over local bucket times start at local midnight, whatever the zone of the measurements.
LENGTHS = {"hourly": "1 hour", "daily": "1 day"}


def windowed_counts(measurements: DataFrame, level: str, grace: str = GRACE) -> DataFrame:
    """Value counts of each host and closed local hour or day, by ``bucket_start``.

    The state of a window is one row per distinct value, so it is bounded by the
    two-decimal value range and not by the records. All values of a window leave
    together, when the watermark passes its end.
    """
    timed = measurements.withColumn("event_time", F.col("bucket_start").cast("timestamp")).withWatermark("event_time", grace)
    window = F.window("event_time", LENGTHS[level]).alias("w")
    counts = rollup.counted(rollup.entries(timed, "event_time"), window)
    return counts.withColumn("period", F.col("w.start").cast("timestamp_ntz")).drop("w")


def run_full_rollup(measurements: DataFrame, level: str, folder: str, grace: str = GRACE) -> str:
    """Whole summaries (medians, percentiles, top lists, anomalies) of closed windows into ``folder/data``.

    Counting is the stream's work; a micro-batch ranks the windows it closed with
    the code of the batch roll-up and replaces their partitions, so a batch that is
    repeated after a failure gives the same table.
    """
    period_type = "date" if level == "daily" else "timestamp_ntz"

    def close(counts: DataFrame, _: int) -> None:
        # The batch feeds hosts and ``all``; the state store must be asked once only.
        counts = counts.withColumn("period", F.col("period").cast(period_type)).persist()
        try:
            done = rollup.summaries_of(rollup.with_counts_of_all(counts), level)
            sinks.write_summaries(done, level, f"{folder}/data")
        finally:
            counts.unpersist()

    query = (
        windowed_counts(measurements, level, grace)
        .writeStream.foreachBatch(close)
        .outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return f"{folder}/data"


SILENCE = "host_id string, kind string, last_seen timestamp, at timestamp"


def host_silence(measurements: DataFrame, gap_minutes: int, grace: str = GRACE) -> DataFrame:
    """A row when a host falls silent, while it is, and one when it comes back.

    ``silent`` comes as soon as the watermark is ``gap_minutes`` past the last
    record, by an event-time timer of the host; ``back`` with the next record. A host
    is two numbers of state. Silences inside one batch are found there.
    """
    gap = gap_minutes * 60_000

    def host(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, silent = state.get if state.exists else (None, False)
        out: list[tuple] = []
        if state.hasTimedOut:
            out.append(("silent", last, last + gap))
            state.update((last, True))
        else:
            seen = np.sort(np.concatenate([b["ms"].to_numpy(np.int64) for b in batches]))
            if last is not None:
                seen = seen[seen > last]
                if silent and len(seen):
                    out.append(("back", last, int(seen[0])))
            line = seen if last is None or silent else np.r_[last, seen]
            for at in np.flatnonzero(np.diff(line) > gap).tolist():
                out += [("silent", int(line[at]), int(line[at]) + gap), ("back", int(line[at]), int(line[at + 1]))]
            if len(seen):
                last, silent = int(seen[-1]), False
            if not silent:
                if last + gap <= state.getCurrentWatermarkMs():
                    out.append(("silent", last, last + gap))
                    silent = True
                else:
                    state.setTimeoutTimestamp(last + gap)
            state.update((last, silent))
        rows = pd.DataFrame([(key[0], *r) for r in out], columns=["host_id", "kind", "last_seen", "at"])
        for c in ("last_seen", "at"):
            rows[c] = pd.to_datetime(rows[c], unit="ms")
        yield rows

    timed = with_event_time(measurements, grace).select("host_id", "event_time", F.unix_millis("event_time").alias("ms"))
    found = timed.groupBy("host_id").applyInPandasWithState(
        host, SILENCE, "last_seen long, silent boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("last_seen", "at")})


def distinct_events(rows: DataFrame, keys: list[str], grace: str = GRACE) -> DataFrame:
    """First arrival of each key within the watermark."""
    return with_event_time(rows, grace).dropDuplicatesWithinWatermark(keys)


def first_per_bucket(measurements: DataFrame) -> DataFrame:
    """First measurement of each host and 15-minute bucket, emitted when the bucket closes."""
    columns = [c for c in measurements.columns if c not in ("host_id", "event_time")]
    timed = with_event_time(measurements)
    first = F.min_by(F.struct(*columns), F.struct("ts", "seq")).alias("m")
    return timed.groupBy(F.window("event_time", "15 minutes").alias("w"), "host_id").agg(first).select("host_id", "m.*")


def windowed_counters(logs: DataFrame) -> DataFrame:
    """Log counters per five minutes."""
    named = with_event_time(logs).select("event_time", F.explode(oplogs.counted_metrics()).alias("metric"))
    return (
        named.groupBy(F.window("event_time", f"{oplogs.STEP} seconds").alias("w"), "metric")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("metric", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")
    )


def silent_hosts(measurements: DataFrame, gap: str) -> DataFrame:
    """A row when a host has sent nothing for ``gap``: its activity session has closed."""
    timed = with_event_time(measurements)
    return (
        timed.groupBy(F.session_window("event_time", gap).alias("w"), "host_id")
        .agg(F.max("event_time").alias("last_seen"), F.count(F.lit(1)).alias("records"))
        .select(
            "host_id",
            F.col("last_seen").cast("timestamp_ntz").alias("last_seen"),
            F.col("w.end").cast("timestamp_ntz").alias("silent_since"),
            "records",
        )
    )


# --- running ----------------------------------------------------------------


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Process all that is available into a parquet table at ``folder/data``."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/data")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def land_first_writes(measurements: DataFrame, folder: str) -> None:
    """Insert-if-absent per host and bucket, batch after batch.

    A batch that is replayed after a failure finds its rows landed and adds none.
    """
    schema = T.StructType([*measurements.schema.fields, T.StructField("day", T.IntegerType())])

    def land(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            there = spark.read.schema(schema).parquet(f"{folder}/data")
        except AnalysisException as problem:  # the first batch finds no folder yet
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            there = spark.createDataFrame([], schema)
        sinks.land_new(batch, there, f"{folder}/data")

    query = (
        measurements.writeStream.foreachBatch(land)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def refresh_days(landed: DataFrame, touched: DataFrame, table: str) -> None:
    """Late data: build the days of the touched rows again and replace just those partitions."""
    days = touched.select(F.col("bucket_start").cast("date").alias("_day")).distinct()
    rows = landed.withColumn("_day", F.col("bucket_start").cast("date"))
    rows = rows.join(days, "_day", "left_semi").drop("_day")
    sinks.write_summaries(rollup.daily(rows), "daily", table)


def reprocess_date(landed: DataFrame, date: datetime, table: str) -> None:
    """Manual run of one day: idempotent, other days keep their rows."""
    sinks.write_summaries(jobs.run("daily", landed, date, date), "daily", table)


def closed_and_open(measurements: DataFrame, as_of: datetime, minutes: int = 15) -> tuple[DataFrame, DataFrame]:
    """Rows of the day before the cut-off, which no longer change, and those after it."""
    cut = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(minutes))
    return measurements.where(F.col("local_ts") < cut), measurements.where(F.col("local_ts") >= cut)


def keep_first_batch(rows: DataFrame) -> DataFrame:
    """Batch counterpart of ``first_per_bucket``."""
    return quality.keep_oldest(rows, ["host_id", "bucket_start"], ["ts", "seq"])

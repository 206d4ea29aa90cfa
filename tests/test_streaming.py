"""Streams against their batch counterparts, over several batches and restarts."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from netpulse.operators import rollup
from netpulse.sources import tables
from netpulse.schemas import EVENTS
from netpulse.streaming import jobs as streams


def parts(spark, sf_dir, folder, n=4):
    """The events table as n files in time order, so that a stream sees n batches."""
    events = tables.table(spark, sf_dir, "events")
    total = events.count()
    for i in range(n):
        low, high = total * i // n, total * (i + 1) // n
        events.where((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(folder)
    return events


def source(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_windows_equal_batch(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "in")
    events = parts(spark, sf_dir, folder)
    batch = streams.windowed_rollup(tables.as_measurements(events), "hourly")
    out = str(tmp_path / "out")
    stream = streams.windowed_rollup(tables.as_measurements(source(spark, folder)), "hourly")
    streams.run_to_table(stream, out)
    got = spark.read.parquet(f"{out}/data")
    newest = events.agg(F.max("ts")).head()[0]
    closed = batch.where(
        F.col("period") + F.expr("interval 1 hour") <= F.lit(newest).cast("timestamp_ntz") + F.expr("interval 320 minutes")
    )
    assert got.count() == closed.count()
    assert got.exceptAll(closed).count() == 0


def test_first_writes_land_once_across_batches_and_restarts(spark, sf_dir, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = parts(spark, sf_dir, folder)
    columns = ["seq", "ts", "host_id", "bucket_start", "download_c"]
    m = tables.as_measurements(source(spark, folder)).select(*columns)
    streams.land_first_writes(m, out)
    first = spark.read.parquet(f"{out}/data").select("host_id", "bucket_start", "seq")
    want = streams.keep_first_batch(tables.as_measurements(events).select(*columns)).select("host_id", "bucket_start", "seq")
    assert first.exceptAll(want).count() == 0 and want.exceptAll(first).count() == 0
    # The same events delivered again, then a restart: nothing new lands.
    events.coalesce(1).write.mode("append").parquet(folder)
    streams.land_first_writes(tables.as_measurements(source(spark, folder)).select(*columns), out)
    again = spark.read.parquet(f"{out}/data").select("host_id", "bucket_start", "seq")
    assert again.count() == want.count()


def test_redelivered_events_are_dropped(spark, sf_dir, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = parts(spark, sf_dir, folder, 1)
    events.coalesce(1).write.mode("append").parquet(folder)
    kept = streams.distinct_events(source(spark, folder), ["event_id"], "40 days").select("event_id")
    streams.run_to_table(kept, out)
    got = spark.read.parquet(f"{out}/data")
    assert got.count() == events.count() == got.distinct().count()


def test_closed_and_open_parts(spark, sf_dir):
    from datetime import datetime

    m = tables.measurements(spark, sf_dir)
    done, running = streams.closed_and_open(m, datetime(2024, 1, 15, 12))
    assert done.count() + running.count() == m.count()
    assert done.agg(F.max("local_ts")).head()[0] < datetime(2024, 1, 15, 11, 45)


def test_full_rollups_equal_batch_over_batches_and_restarts(spark, sf_dir, tmp_path):
    """Medians, percentiles and top lists of closed windows, with half of the files arriving after a restart."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = tables.table(spark, sf_dir, "events")
    half = events.count() // 2
    for part in (events.where(F.col("event_id") < half), events.where(F.col("event_id") >= half)):
        part.coalesce(1).write.mode("append").parquet(folder)
        table = streams.run_full_rollup(tables.as_measurements(source(spark, folder)), "daily", out)
    batch = rollup.daily(tables.as_measurements(events))
    newest = tables.as_measurements(events).agg(F.max("bucket_start")).head()[0]
    closed = batch.where(F.col("period").cast("timestamp_ntz") + F.expr("interval 1 day 10 minutes") <= F.lit(newest))
    columns = [c for c in batch.columns if batch.schema[c].dataType.typeName() != "map"]
    got, want = spark.read.parquet(table).select(columns), closed.select(columns)
    assert got.count() == want.count() > 0
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hosts_fall_silent_and_come_back(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "host_id string, ts timestamp_ntz"

    def arrive(rows):
        at = [(h, datetime(2024, 1, 1, 0, 0) + timedelta(minutes=m)) for h, m in rows]
        spark.createDataFrame(at, kind).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)
        streams.run_to_table(streams.host_silence(stream, 45), out)
        found = spark.read.parquet(f"{out}/data").orderBy("host_id", "at", "kind").collect()
        return [(r["host_id"], r["kind"], int((r["at"] - datetime(2024, 1, 1)).total_seconds()) // 60) for r in found]

    # Host a goes on; host b stops after 10 minutes, and is reported while it is silent.
    assert arrive([("a", 0), ("b", 10), ("a", 30), ("a", 60), ("a", 100)]) == [("b", "silent", 55)]
    # It comes back at 130; another one stops, and a pause of exactly the gap is none.
    assert arrive([("b", 130), ("a", 145), ("c", 131)]) == [("b", "silent", 55), ("b", "back", 130)]
    want = [("b", "silent", 55), ("b", "back", 130), ("b", "silent", 175), ("b", "back", 190), ("c", "silent", 176)]
    assert sorted(arrive([("a", 190), ("b", 190)])) == sorted(want)
    # Nothing new, nothing more; the state outlives the restarts.
    assert sorted(arrive([("a", 191)])) == sorted(want)

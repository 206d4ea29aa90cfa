"""Layouts, inventories, sinks and versions on real files."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netpulse.operators import quality, retention, rollup, validate
from netpulse.plans import jobs
from netpulse.sinks import tables as sinks
from netpulse.sources import files, logs, tables
from netpulse.sources.normalize import is_valid, normalize
from netpulse.streaming import jobs as streams


def record(at, host=None, **changes):
    body = {
        "timestamp_utc": (at - timedelta(minutes=330)).strftime("%Y-%m-%dT%H:%M:%S+00:00"),
        "timestamp_ist": at.strftime("%Y-%m-%d %H:%M:%S IST"),
        "download_mbps": "191.17 Mbps", "upload_mbps": "98.4 Mbps", "ping_ms": "6.58 ms",
        "server_name": "Net A", "server_city": "Town", "server_country": "Land", "server_host": "s1", "server_id": 101,
        "result_url": "https://example.net/r/1", "public_ip": "203.0.113.9", "connection_type": "Wi-Fi 5GHz",
    }
    if host:
        body["host_id"] = host
    return {k: v for k, v in {**body, **changes}.items() if v is not ...}


def put(root, at, body, host=None, name="a.json"):
    """Write one pretty-printed file at its 15-minute path."""
    parts = [f"host={host}"] if host else []
    parts += [at.strftime(p) for p in ("year=%Y", "month=%Y%m", "day=%Y%m%d", "hour=%Y%m%d%H", "minute=%Y%m%d%H%M")]
    folder = os.path.join(root, *parts)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as out:
        out.write(body if isinstance(body, str) else json.dumps(body, indent=2))


def fixture(root):
    at = datetime(2025, 12, 29, 14, 0)
    put(root, at, record(at + timedelta(minutes=2), "h1"), "h1")
    put(root, at, record(at + timedelta(minutes=3), "h1"), "h1", "b.json")
    put(root, at, record(at + timedelta(minutes=1), "h2"), "h2")
    put(root, at, record(at + timedelta(minutes=1)))  # legacy
    late = datetime(2025, 12, 29, 14, 45)
    put(root, late, record(datetime(2025, 12, 29, 15, 0, 30), "h1", ping_ms=""), "h1")  # done after its hour
    put(root, late, record(late, "h2", download_mbps="n/a"), "h2")
    put(root, late, record(late, "h2", server_name=..., server_city="", public_ip="Unknown"), "h2", "c.json")
    put(root, datetime(2025, 12, 30, 0, 0), '{"download_mbps": "1 Mb', "h2")  # broken
    return at


def test_both_layouts_read_as_one(spark, tmp_path):
    root = str(tmp_path)
    fixture(root)
    raw = files.read_raw(spark, root)
    m = normalize(raw).cache()
    assert m.count() == 8
    assert {r["host_id"] for r in quality.list_hosts(m).collect()} == {"h1", "h2", "_legacy"}
    assert raw.cache().where("corrupt").count() == 1
    # The path decides the hour, whenever the measurement finished.
    hours = {(r["host_id"], r["period"]): r for r in rollup.hourly(m).collect()}
    assert hours[("h1", datetime(2025, 12, 29, 14))]["records"] == 3
    assert ("h1", datetime(2025, 12, 29, 15)) not in hours
    every = hours[("all", datetime(2025, 12, 29, 14))]
    assert (every["records"], every["errors"]) == (6, 1)
    assert every["overall"]["ping_ms"]["avg"] == 6.58
    # A day with nothing but an unreadable record has no summary; the record is still an error of that day.
    assert not [k for k in hours if k[1] >= datetime(2025, 12, 30)]
    broken = m.where(~is_valid() & (F.col("bucket_start") >= F.lit(datetime(2025, 12, 30)).cast("timestamp_ntz")))
    assert [r["host_id"] for r in broken.collect()] == ["h2"]
    labels = {r["server_label"] for r in m.where("server_name is null and server_host is not null").collect()}
    assert labels == {"s1 (Land)"}


def test_one_layout_is_enough(spark, tmp_path):
    at = datetime(2025, 12, 29, 14, 0)
    hosts, legacy = str(tmp_path / "hosts"), str(tmp_path / "legacy")
    put(hosts, at, record(at, "h1"), "h1")
    put(legacy, at, record(at))
    for root, host in ((hosts, "h1"), (legacy, "_legacy")):
        found = files.read_raw(spark, root).select("host", "bucket_start").collect()
        assert [tuple(r) for r in found] == [(host, at)]
    with pytest.raises(FileNotFoundError):
        files.read_raw(spark, str(tmp_path / "none"))


def test_day_filter_prunes_folders(spark, tmp_path):
    root = str(tmp_path)
    fixture(root)
    day = files.for_days(files.read_raw(spark, root), 20251229, 20251229)
    assert day.count() == 7
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "day" in plan.split("PartitionFilters")[1][:400]
    later = files.read_raw(spark, root, modified_after=datetime(2035, 1, 1))
    assert later.count() == 0


def test_inventory_finds_duplicates(spark, tmp_path):
    root = str(tmp_path)
    fixture(root)
    inv = files.keyed_inventory(files.inventory(spark, root))
    groups = {(r["host_id"], r["period_key"]): r["files"] for r in quality.duplicate_groups(inv).collect()}
    assert groups == {("h1", "2025-12-29 14:00"): 2, ("h2", "2025-12-29 14:45"): 2}
    assert {r["level"] for r in inv.collect()} == {"minutes"}


def test_summary_partitions_are_replaced_alone(spark, tmp_path, sf_dir):
    table = str(tmp_path / "daily")
    m = tables.measurements(spark, sf_dir)
    days = rollup.daily(m)
    sinks.write_summaries(days, "daily", table)
    before = sinks.read_summaries(spark, table).count()
    # A repeated run changes nothing; one with a month missing leaves the others.
    streams.reprocess_date(m, datetime(2024, 1, 5), table)
    assert sinks.read_summaries(spark, table).count() == before == days.count()
    extra = m.where("bucket_start < timestamp_ntz'2024-01-02 00:00:00'").withColumn("bucket_start", F.expr("bucket_start + interval 60 days"))
    streams.refresh_days(extra, extra, table)
    after = sinks.read_summaries(spark, table)
    assert after.where("period >= date'2024-02-15'").count() > 0
    assert after.where("period < date'2024-02-15'").count() == before
    # Deleting writes what remains as a new version.
    plan = retention.last_n(after.select("host_id", "period"), "daily", datetime(2024, 1, 31), 5)
    sinks.write_version(retention.retained(after, plan), str(tmp_path / "v2"), ["year", "month", "day"])
    assert spark.read.parquet(str(tmp_path / "v2")).count() == after.count() - plan.count()


def test_documents_manifest_and_drift(spark, tmp_path):
    root = tmp_path / "docs"
    bodies = {
        "monthly/a.json": {"month": "202501", "days": 31, "avg_download": 10.5, "avg_upload": 2, "avg_ping": 3, "host_id": "h"},
        "monthly/b.json": {"month": "202502", "count": 3, "avg_download_mbps": 7, "public_ip": "1.1.1.1"},
        "monthly/c.json": {"overall": {"download_mbps": {"avg": 4.25}}, "records": 9, "public_ips": ["2.2.2.2", "3.3.3.3"]},
    }
    for name, body in bodies.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(body, indent=1))
    docs = files.documents(spark, str(root))
    got = {r["key"][-6:]: r for r in files.drifted_means(docs).collect()}
    assert [got[k]["avg_download"] for k in ("a.json", "b.json", "c.json")] == [10.5, 7.0, 4.25]
    assert [got[k]["samples"] for k in ("a.json", "b.json", "c.json")] == [31, 3, 9]
    assert got["b.json"]["public_ips"] == ["1.1.1.1"] and got["c.json"]["public_ips"] == ["2.2.2.2", "3.3.3.3"]
    assert got["b.json"]["host_id"] == "_legacy"
    manifest = tmp_path / "manifest.json"
    entries = [{"bucket": "b", "key": f"monthly/{n}.json", "type": "monthly"} for n in ("a", "b")]
    manifest.write_text(json.dumps({"timestamp": "t", "files_created": 2, "files": entries}))
    listed = files.manifest(spark, str(manifest))
    named = docs.select(F.regexp_extract("key", "monthly/.*$", 0).alias("key"), "doc", F.lit("monthly").alias("type"))
    chosen = validate.restrict_to_manifest(named, listed)
    report = validate.report(validate.validate(chosen, "monthly", 2025)).head()
    assert (report["total"], report["valid"], report["invalid"]) == (2, 1, 1)


def test_manifest_table_grows(spark, tmp_path, sf_dir):
    path = str(tmp_path / "manifest")
    built = rollup.daily(tables.measurements(spark, sf_dir)).where("host_id = 'all'")
    for _ in range(2):
        sinks.append_manifest(jobs.manifest(built, "daily", datetime(2024, 2, 1)), path)
    rows = spark.read.parquet(path)
    assert rows.count() == 2 * built.count()
    assert rows.where("key = 'aggregated/year=2024/month=202401/day=20240105/summary.json'").count() == 2


def test_log_lines_from_files(spark, tmp_path):
    line = {"timestamp": "2025-01-01T00:00:01+00:00Z", "level": "INFO", "message": "Completed: f in 1.5s", "elapsed_seconds": 1.5}
    (tmp_path / "l.json").write_text(json.dumps(line) + "\n")
    row = logs.read(spark, str(tmp_path)).head()
    assert row["ts"] == datetime(2025, 1, 1, 0, 0, 1) and row["elapsed_c"] == 150


def test_compaction_keeps_rows(spark, tmp_path, sf_dir):
    m = tables.measurements(spark, sf_dir)
    sinks.compact(m, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c")).drop("month")
    assert back.count() == m.count() and back.exceptAll(m.select(*back.columns)).count() == 0


def test_one_hour_replaces_only_itself(spark, tmp_path, sf_dir):
    table = str(tmp_path / "hourly")
    m = sinks.with_day(tables.measurements(spark, sf_dir))
    sinks.write_summaries(rollup.hourly(m), "hourly", table)
    before = sinks.read_summaries(spark, table).count()
    sinks.write_summaries(jobs.run("hourly", m, datetime(2024, 1, 5, 8, 10)), "hourly", table)
    again = sinks.read_summaries(spark, table)
    assert again.count() == before and again.groupBy("host_id", "period").count().where("count > 1").count() == 0


def test_lists_are_whole_in_the_member_table(spark, sf_dir, tmp_path):
    members = rollup.members(tables.measurements(spark, sf_dir), "daily")
    sinks.write_members(members, str(tmp_path / "members"))
    back = sinks.read_summaries(spark, str(tmp_path / "members"))
    assert back.count() == members.count() and {r["kind"] for r in back.select("kind").distinct().collect()} >= {"host", "ip", "url"}


def test_exported_documents_are_replaced_by_period(spark, tmp_path, sf_dir):
    root = str(tmp_path / "daily")
    days = rollup.daily(tables.measurements(spark, sf_dir)).persist()
    docs = sinks.as_documents(days, "daily")
    sinks.export_documents(docs, "daily", root)
    some = docs.where("period = DATE '2024-01-05'")
    sinks.export_documents(some.withColumn("doc", F.lit("again")), "daily", root)
    read = files.documents(spark, root, "*.txt", whole=False)
    assert read.count() == days.count()
    assert read.where("doc = 'again'").count() == some.count() > 1
    listed = files.keyed_inventory(files.inventory(spark, root, "*.txt"))
    assert {r["level"] for r in listed.select("level").distinct().collect()} == {"daily"}
    assert listed.where("period_key = '2024-01-05'").count() == some.count()


def test_next_run_reads_what_came_after_the_newest_file(spark, tmp_path):
    root, at = str(tmp_path), datetime(2025, 12, 29, 14, 0)
    assert files.newest(files.inventory(spark, root)) is None
    put(root, at, record(at, "h1"), "h1")
    first = os.path.join(root, "host=h1/year=2025/month=202512/day=20251229/hour=2025122914/minute=202512291400/a.json")
    os.utime(first, (1_700_000_000.25, 1_700_000_000.25))
    put(root, at, record(at, "h1"), "h1", "b.json")
    os.utime(first.replace("a.json", "b.json"), (1_700_000_000.5, 1_700_000_000.5))
    listed = files.inventory(spark, root)
    seen = files.newest(listed.where(F.col("path").endswith("a.json")))
    assert seen == datetime(2023, 11, 14, 22, 13, 20, 250000)
    assert [os.path.basename(r["path"]) for r in files.read_raw(spark, root, modified_after=seen).collect()] == ["b.json"]
    assert files.read_raw(spark, root, modified_after=files.newest(listed)).count() == 0


def test_manifest_of_any_length(spark, tmp_path):
    when = datetime(2024, 2, 1)
    entries = spark.range(2500).select(
        F.lit(when).cast("timestamp_ntz").alias("timestamp"), F.lit("daily").alias("type"), F.lit("b").alias("bucket"),
        F.concat(F.lit("k"), "id").alias("key"),
    )
    docs = sinks.manifest_documents(entries, 100).persist()
    assert docs.count() == 25 and docs.agg(F.sum("files_created")).head()[0] == 2500
    assert docs.where("files_created != size(files)").count() == 0
    docs.write.json(str(tmp_path / "documents"))
    back = files.manifest(spark, str(tmp_path / "documents"), multiline=False)
    assert back.select("key").distinct().count() == back.count() == 2500
    for _ in range(2):
        sinks.write_manifest_run(entries, str(tmp_path / "table"))
    sinks.write_manifest_run(entries.limit(3).withColumn("type", F.lit("weekly")), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2503
    assert sinks.manifest_documents(entries.where("key = ''")).count() == 0

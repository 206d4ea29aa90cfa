"""Roll-ups against a plain Python computation, and their invariants."""

import random
from collections import Counter
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from netpulse.operators import rollup
from netpulse.plans import jobs
from netpulse.sources import tables
from netpulse.sources.normalize import normalize

SCHEMA = (
    "seq bigint, ts timestamp_ntz, local_ts timestamp_ntz, bucket_start timestamp_ntz, host_id string, "
    "download_c bigint, upload_c bigint, ping_c bigint, server_label string, public_ip string, "
    "connection_type string, result_url string"
)
TYPES = ["Wi-Fi 5GHz", "Wi-Fi 2.4GHz", "Ethernet", "Unknown", "Wi-Fi (unknown band)", None, ""]


def rows(n, seed, hot=0.4):
    """Random measurements; one host holds a large share, readings repeat often."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        at = datetime(2024, 12, 29, 22) + timedelta(minutes=15 * rnd.randrange(4 * 30))
        host = "host-1" if rnd.random() < hot else rnd.choice(["host-2", "_legacy"])
        bad = rnd.random() < 0.05
        out.append(
            (
                i, at, at, at, host,
                None if bad else rnd.choice([5, 9000, 12345, rnd.randrange(30000)]),
                rnd.randrange(20000), None if rnd.random() < 0.1 else rnd.randrange(8000),
                rnd.choice(["a", "b", "c", "d", "e", "f", "g"]), f"10.0.0.{i % 9}", rnd.choice(TYPES),
                f"http://x/{i}" if i % 3 else "",
            )
        )
    return out


def cents(num, den):
    return int((Decimal(num) / Decimal(den)).quantize(Decimal(1), ROUND_HALF_UP))


def stats(values):
    ordered, n = sorted(values), len(values)
    if not n:
        return dict.fromkeys(("avg", "median", "max", "min", "p99", "p95", "p90", "p50"))
    at = {f"p{int(p * 100)}": ordered[int(p * (n - 1))] / 100 for p in (0.99, 0.95, 0.9, 0.5)}
    middle = ordered[(n - 1) // 2] + ordered[n // 2]
    return {
        "avg": cents(sum(values), n) / 100, "median": cents(middle, 2) / 100,
        "max": ordered[-1] / 100, "min": ordered[0] / 100, **at,
    }


def most_common(items, k):
    return [x for x, _ in Counter(items).most_common(k)]  # first seen wins ties


def expected(data, level):
    groups = {}
    for r in data:
        period = r[3].replace(minute=0) if level == "hourly" else r[3].date()
        for host in (r[4], "all"):
            groups.setdefault((host, period), []).append(r)
    out = {}
    for key, members in groups.items():
        good = [r for r in members if r[5] is not None]
        if not good:
            continue
        types = [r[10] for r in good if r[10]]
        out[key] = {
            "records": len(good),
            "errors": len(members) - len(good),
            "download_mbps": stats([r[5] for r in good]),
            "upload_mbps": stats([r[6] for r in good]),
            "ping_ms": stats([r[7] for r in good if r[7] is not None]),
            "servers_top": most_common([r[8] for r in good], 3 if level == "hourly" else 5),
            "connection_types": sorted(set(types)) if level == "hourly" else most_common(types, 3),
        }
    return out


@pytest.mark.parametrize("level", ["hourly", "daily"])
@pytest.mark.parametrize("n,seed", [(40, 1), (700, 2)])
def test_summaries_match_plain_python(spark, level, n, seed):
    data = rows(n, seed)
    got = rollup.summaries(spark.createDataFrame(data, SCHEMA), level).collect()
    want = expected(data, level)
    assert {(r["host_id"], r["period"]) for r in got} == set(want)
    for r in got:
        w = want[(r["host_id"], r["period"])]
        for name in ("records", "errors", "servers_top", "connection_types"):
            assert r[name] == w[name], (r["host_id"], r["period"], name)
        for metric in rollup.METRICS:
            assert r["overall"][metric].asDict() == w[metric], metric


def test_all_is_the_sum_of_the_hosts(spark, sf_dir):
    days = rollup.daily(tables.measurements(spark, sf_dir))
    sums = days.groupBy("period").agg(
        F.sum(F.when(F.col("host_id") == "all", F.col("records"))).alias("a"),
        F.sum(F.when(F.col("host_id") != "all", F.col("records"))).alias("b"),
        F.sum(F.when(F.col("host_id") == "all", F.col("errors"))).alias("c"),
        F.sum(F.when(F.col("host_id") != "all", F.col("errors"))).alias("d"),
    )
    assert sums.where("a <> b").count() == 0
    # A day on which a host has errors only has no summary of that host.
    assert sums.where("c < d").count() == 0


def test_statistics_are_ordered(spark, sf_dir):
    days = rollup.daily(tables.measurements(spark, sf_dir))
    for metric in rollup.METRICS:
        s = f"overall.{metric}"
        wrong = days.where(
            f"not ({s}.min <= {s}.p50 and {s}.p50 <= {s}.p90 and {s}.p90 <= {s}.p95 and {s}.p95 <= {s}.p99 "
            f"and {s}.p99 <= {s}.max and {s}.min <= {s}.avg and {s}.avg <= {s}.max and {s}.p50 <= {s}.median)"
        )
        assert wrong.count() == 0


def test_text_and_direct_readers_agree(spark, sf_dir):
    columns = ["seq", "host_id", "bucket_start", "download_c", "upload_c", "ping_c", "server_label", "public_ip"]
    parsed = normalize(tables.raw_measurements(spark, sf_dir)).select(*columns)
    direct = tables.measurements(spark, sf_dir).select(*columns)
    assert parsed.exceptAll(direct).count() == 0 and direct.exceptAll(parsed).count() == 0


def test_anomaly_messages(spark):
    at = datetime(2025, 1, 1, 10)
    data = [
        (i, at, at, at, "h", c, 100, ping, "s", "1.1.1.1", "Wi-Fi 2.4GHz", "")
        for i, (c, ping) in enumerate([(4000, 6000), (10001, 100), (9000, None)])
    ]
    got = rollup.daily(spark.createDataFrame(data, SCHEMA)).where("host_id = 'h'").head()
    assert got["threshold_mbps"] == 100
    assert got["anomalies"] == [
        "Below threshold: avg download 76.67 Mbps < 90.00 Mbps",
        "Severe degradation: min download 40.00 Mbps",
        "Performance drop: avg download 76.67 Mbps < 80 Mbps (2.4GHz threshold)",
        "High latency: avg ping 30.50 ms",
        "Latency spike: max ping 60.00 ms",
        "Low completion rate: 3.1%",
    ]
    assert got["low_data"] and not got["high_errors"] and got["completion_rate"] == 3.1


def test_coarser_levels_are_means_of_rounded_means(spark):
    days = spark.createDataFrame(
        [("h", datetime(2024, 12, 30).date(), 1.0, 1.0, None, ["b"]), ("h", datetime(2025, 1, 5).date(), 2.01, 2.0, 4.0, ["a", "b"]),
         ("h", datetime(2025, 1, 6).date(), 9.0, 9.0, 9.0, [])],
        "host_id string, period date, avg_download double, avg_upload double, avg_ping double, connection_types array<string>",
    )
    weeks = {str(r["period"]): r for r in rollup.coarser(days, "weekly").collect()}
    first = weeks["2024-12-30"]
    assert (first["days"], first["avg_download"], first["avg_ping"], first["connection_types"]) == (2, 1.51, 4.0, ["a", "b"])
    assert weeks["2025-01-06"]["connection_types"] == []
    months = {str(r["period"]): r["days"] for r in rollup.coarser(days, "monthly").collect()}
    assert months == {"2024-12-01": 1, "2025-01-01": 2}


def test_scheduled_run_reads_one_period(spark):
    data = rows(400, 5)
    m = spark.createDataFrame(data, SCHEMA)
    as_of = datetime(2024, 12, 30, 2, 10)
    one_day = jobs.run("daily", m, as_of)
    assert {str(r["period"]) for r in one_day.select("period").distinct().collect()} == {"2024-12-29"}
    whole = rollup.daily(m).where("period = date'2024-12-29'")
    assert one_day.drop("connection_type_thresholds").exceptAll(whole.drop("connection_type_thresholds")).count() == 0
    hour = jobs.run("hourly", m, as_of).select("period").distinct().collect()
    assert [r["period"] for r in hour] == [datetime(2024, 12, 30, 1)]


def test_backfill_builds_periods_that_lack_a_host_whole(spark):
    m = spark.createDataFrame(rows(400, 6), SCHEMA)
    full = rollup.daily(m).select("host_id", "period")
    existing = full.where("not (host_id in ('all', 'host-2') and period = date'2024-12-30')")
    built = jobs.backfill("daily", m, datetime(2025, 2, 1), existing=existing).select("host_id", "period")
    day = full.where("period = date'2024-12-30'")
    assert day.count() > 2 and sorted(built.collect()) == sorted(day.collect())
    assert jobs.backfill("daily", m, datetime(2024, 12, 30, 9)).where("period >= date'2024-12-30'").count() == 0
    assert jobs.backfill("daily", m, datetime(2024, 12, 30, 9), force=True).where("period >= date'2024-12-30'").count() > 0


def test_members_are_whole(spark):
    data = rows(300, 7)
    members = rollup.members(spark.createDataFrame(data, SCHEMA), "daily")
    good = [r for r in data if r[5] is not None]
    urls = members.where("host_id = 'all' and kind = 'url'")
    assert urls.count() == len([r for r in good if r[11].startswith("http")])
    ips = {r["item"] for r in members.where("host_id = 'all' and kind = 'ip'").collect()}
    assert ips == {r[9] for r in good}


def test_means_without_ranks_equal_those_of_summaries(spark, sf_dir):
    m = tables.measurements(spark, sf_dir)
    for level in ("hourly", "daily"):
        whole = rollup.as_period_means(rollup.summaries(m, level), "records").drop("connection_types")
        means = rollup.period_means(m, level).select(*whole.columns)
        assert means.count() == whole.count() > 0
        assert means.exceptAll(whole).isEmpty()
    weeks = rollup.coarser(rollup.period_means(m, "daily"), "weekly")
    wanted = rollup.weekly(rollup.daily(m)).select(*weeks.columns)
    assert "connection_types" not in weeks.columns
    assert weeks.exceptAll(wanted).isEmpty() and wanted.exceptAll(weeks).isEmpty()
    assert rollup.period_means(m.where("host_id = ''"), "daily").count() == 0

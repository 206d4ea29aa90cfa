"""Duplicates, gaps, validators and retention on small frames."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netpulse.operators import oplogs, quality, retention, rollup, validate, views
from netpulse.sinks import tables as sinks
from netpulse.sources import tables

INVENTORY = "level string, host_id string, period_key string, path string, modified timestamp_ntz"
T0 = datetime(2025, 1, 1)


def test_oldest_copy_stays_even_in_a_hot_group(spark):
    files = [("minutes", "h1", "202501010000", f"p{i:05d}", T0 + timedelta(seconds=(i * 37) % 1000)) for i in range(3000)]
    files += [("minutes", "h2", "202501010000", "q0", T0), ("minutes", "h1", "Unknown", "u0", T0), ("minutes", "h1", "Unknown", "u1", T0)]
    inv = spark.createDataFrame(files, INVENTORY)
    groups = quality.duplicate_groups(inv).collect()
    # The same bucket on another host is no duplicate, an unparseable key is left alone.
    assert [(g["host_id"], g["files"]) for g in groups] == [("h1", 3000)]
    gone = {r["path"] for r in quality.files_to_delete(inv).collect()}
    oldest = min(files[:3000], key=lambda f: (f[4], f[3]))[3]
    assert gone == {f[3] for f in files[:3000]} - {oldest}
    left = inv.join(spark.createDataFrame([(p,) for p in gone], "path string"), "path", "left_anti")
    assert quality.files_to_delete(left).count() == 0  # idempotent
    assert quality.duplicate_totals(inv).head().asDict() == {"level": "minutes", "buckets": 1, "duplicates": 2999}


def test_report_shows_newest_buckets_and_counts_the_rest(spark):
    files = [
        ("minutes", "h", f"2025010100{b:02d}", f"{b}-{c}", T0 + timedelta(seconds=c)) for b in range(25) for c in range(2)
    ]
    report = quality.duplicate_report(spark.createDataFrame(files, INVENTORY)).collect()
    assert len(report) == 40
    assert {r["buckets_in_all"] for r in report} == {25} and {r["more_buckets"] for r in report} == {5}
    assert min(r["period_key"] for r in report) == "202501010005"


def test_insert_if_absent(spark):
    schema = "host_id string, bucket int, ts timestamp_ntz, seq bigint"
    landed = spark.createDataFrame([("h", 1, T0, 1)], schema)
    incoming = spark.createDataFrame([("h", 1, T0, 2), ("h", 2, T0, 4), ("h", 2, T0, 3), ("g", 1, T0, 5)], schema)
    got = quality.insert_if_absent(incoming, landed, ["host_id", "bucket"], ["ts", "seq"])
    assert {(r["host_id"], r["bucket"], r["seq"]) for r in got.collect()} == {("h", 2, 3), ("g", 1, 5)}


def test_missing_days_of_weeks_and_months(spark):
    present = spark.createDataFrame([("h", date(2024, 12, 30)), ("h", date(2025, 1, 1)), ("h", date(2025, 1, 5))], "host_id string, period date")
    weeks = {str(r["period"]) for r in quality.missing_periods(present, "daily", "weekly").collect()}
    assert weeks == {"2024-12-31", "2025-01-02", "2025-01-03", "2025-01-04"}
    months = quality.missing_periods(present, "daily", "monthly")
    assert months.count() == 62 - 3


def test_missing_periods_go_on_to_as_of(spark):
    present = spark.createDataFrame([("h", date(2025, 1, 1)), ("g", date(2025, 1, 14)), ("late", date(2025, 1, 15))], "host_id string, period date")
    got = quality.missing_periods(present, "daily", "weekly", datetime(2025, 1, 15, 9)).collect()
    assert {r["host_id"]: sum(x["host_id"] == r["host_id"] for x in got) for r in got} == {"h": 15, "g": 1}
    assert max(r["period"] for r in got) == date(2025, 1, 14)


def test_missing_data_alarm_fires_when_all_logs_stop(spark):
    rows = [(i, datetime(2025, 1, d, 5), "INFO", "Aggregated 3 records", "/app/netpulse-aggregator-prod") for i, d in enumerate((1, 2, 2))]
    rows += [(9 + i, datetime(2025, 1, 5, 8), "ERROR", "x", "/app/netpulse-dashboard-prod") for i in range(6)]
    logs = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, level string, message string, log_group string")

    def states(logs, as_of, alarm):
        rows = oplogs.alarm_states(logs, as_of).where(F.col("alarm") == alarm).orderBy("window_start").collect()
        return [(r["window_start"].day, r["state"]) for r in rows]

    stopped = logs.where("event_id < 9")
    # The 5th is not over at half past eight: nothing yet is no breach.
    days = states(stopped, datetime(2025, 1, 5, 8, 30), "data-collection-failure")
    assert days == [(1, "OK"), (2, "OK"), (3, "OK"), (4, "ALARM"), (5, "OK")]
    # Too many errors are one at once; later lines are not looked at.
    hours = oplogs.alarm_states(logs, datetime(2025, 1, 5, 8, 30)).where("alarm = 'dashboard-errors' AND breaching")
    assert [r["value"] for r in hours.collect()] == [6]
    assert oplogs.alarm_states(logs, datetime(2025, 1, 5, 8)).where("alarm = 'dashboard-errors' AND breaching").count() == 0


def test_silent_hours(spark):
    hours = [datetime(2025, 1, 1, h) for h in (0, 1, 4, 5, 7, 11)]
    m = spark.createDataFrame([("h", h) for h in hours], "host_id string, bucket_start timestamp_ntz")
    assert sorted(r["hour"].hour for r in oplogs.no_data_periods(m).collect()) == [3, 9, 10]
    assert sorted(r["hour"].hour for r in oplogs.no_data_periods(m, 3).collect()) == [10]
    ongoing = oplogs.no_data_periods(m, as_of=datetime(2025, 1, 1, 15, 20))
    assert sorted(r["hour"].hour for r in ongoing.collect()) == [3, 9, 10, 13, 14]
    before = oplogs.no_data_periods(m, as_of=datetime(2025, 1, 1, 10))
    assert sorted(r["hour"].hour for r in before.collect()) == [3, 9]


def test_coverage(spark):
    at = datetime(2025, 1, 1, 7)
    rows = [("h1", at), ("h1", at), ("h1", at + timedelta(minutes=15)), ("h2", at + timedelta(minutes=30))]
    m = spark.createDataFrame(rows, "host_id string, bucket_start timestamp_ntz")
    got = {r["host_id"]: (r["distinct_minutes"], r["records"], r["coverage_percent"]) for r in quality.coverage(m).collect()}
    assert got == {"h1": (2, 3, 50.0), "h2": (1, 1, 25.0), "all": (3, 4, 75.0)}


def check(spark, level, doc, year=2025):
    text = doc if isinstance(doc, str) else json.dumps(doc)
    df = spark.createDataFrame([("k", text)], "key string, doc string")
    row = validate.validate(df, level, year).head()
    return row["valid"], row["errors"], row["warnings"]


STATS = {"avg": 1.5, "median": 1, "max": 2, "min": 1}
HOUR = {"hour_ist": "2025-01-01 07:00", "records": 4, "overall": {m: STATS for m in validate.METRICS}}
DAY = {**HOUR, "date_ist": "2025-01-01", "records": 96, "completion_rate": 100.0}
WEEK = {"week_start": "2025-01-06", "week_end": "2025-01-12", "days": 7, "avg_download": 1.0, "avg_upload": 2, "avg_ping": 3}
MONTH = {"month": "202501", "days": 31, "avg_download": 1.0, "avg_upload": 2, "avg_ping": 3}
YEAR = {"year": 2025, "months_aggregated": 12, "avg_download": 1.0, "avg_upload": 2, "avg_ping": 3}


@pytest.mark.parametrize("level,doc", [("hourly", HOUR), ("daily", DAY), ("weekly", WEEK), ("monthly", MONTH), ("yearly", YEAR)])
def test_sound_documents_pass(spark, level, doc):
    assert check(spark, level, doc) == (True, [], [])


@pytest.mark.parametrize(
    "level,change,errors,warnings",
    [
        ("hourly", {"records": 5}, [], ["records=5 exceeds expected 4 per hour"]),
        ("hourly", {"records": 0}, [], ["records is 0 - empty aggregation"]),
        ("hourly", {"records": "4"}, ["Field records has wrong type: expected int"], []),
        ("hourly", {"records": None}, ["Field records has wrong type: expected int"], []),
        ("daily", {"date_ist": "01.02.2025"}, ["Invalid date format: 01.02.2025, expected YYYY-MM-DD"], []),
        ("daily", {"date_ist": "2025-02-30"}, ["Invalid date format: 2025-02-30, expected YYYY-MM-DD"], []),
        ("daily", {"completion_rate": -1}, ["completion_rate=-1 cannot be negative"], []),
        ("weekly", {"days": 8}, ["days=8 exceeds 7 for a week"], []),
        ("weekly", {"avg_ping": 1001}, [], ["avg_ping=1001 is above maximum 1000"]),
        ("weekly", {"week_end": 7}, ["Field week_end has wrong type: expected string"], []),
        ("monthly", {"month": "2025-1"}, ["Invalid month format: 2025-1, expected YYYYMM"], []),
        ("monthly", {"days": 32}, ["days=32 exceeds 31 for a month"], []),
        ("yearly", {"year": 2019}, ["year=2019 seems invalid"], []),
        ("yearly", {"year": 2026}, [], []),
        ("yearly", {"year": 2027}, ["year=2027 seems invalid"], []),
        ("yearly", {"months_aggregated": 13}, ["months_aggregated=13 exceeds 12"], []),
        ("yearly", {"avg_upload": -0.5}, [], ["avg_upload=-0.5 is below minimum 0"]),
    ],
)
def test_faults_are_named(spark, level, change, errors, warnings):
    doc = {**{"hourly": HOUR, "daily": DAY, "weekly": WEEK, "monthly": MONTH, "yearly": YEAR}[level], **change}
    assert check(spark, level, doc) == (not errors, errors, warnings)


def test_missing_parts_and_broken_text(spark):
    assert check(spark, "monthly", "{broken")[1] == ["Invalid JSON"]
    assert check(spark, "hourly", {"hour_ist": "x"})[1] == ["Missing required field: records", "Missing required field: overall"]
    less = {m: {k: v for k, v in STATS.items() if k != "max"} for m in validate.METRICS}
    assert len(check(spark, "hourly", {**HOUR, "overall": less})[1]) == 3
    assert check(spark, "daily", {**DAY, "overall": less})[0] and len(check(spark, "daily", {**DAY, "overall": less})[2]) == 3


def test_own_summaries_validate(spark, sf_dir):
    days = rollup.daily(tables.measurements(spark, sf_dir))
    docs = sinks.as_documents(days, "daily").select(F.concat_ws("/", "host_id", F.col("period").cast("string")).alias("key"), "doc")
    results = validate.validate(docs, "daily", 2024)
    assert results.where("not valid").count() == 0 and results.count() == days.count()


def test_retention_and_last_n(spark):
    days = [date(2025, 1, 1) + timedelta(days=i) for i in range(400)]
    keys = spark.createDataFrame([("h", d) for d in days], "host_id string, period date")
    weeks = quality.coarser_keys(keys, "weekly")
    as_of = datetime(2027, 1, 20)
    plan = retention.expired(weeks, "weekly", as_of)
    assert all(r["period"] < (as_of - timedelta(days=730)).date() for r in plan.collect())
    kept = retention.retained(weeks, plan)
    assert kept.count() + plan.count() == weeks.count()
    assert retention.expired(keys, "daily", as_of).count() == 0
    last = retention.last_n(weeks, "weekly", datetime(2026, 1, 28), 2).collect()
    assert {str(r["period"]) for r in last} == {"2026-01-19", "2026-01-26", "2026-02-02"}
    assert retention.last_n(weeks, "weekly", as_of, None).count() == weeks.count()


def test_preference_for_all_hosts(spark):
    rows = [("h1", date(2025, 1, 1), 1), ("all", date(2025, 1, 1), 2), ("h2", date(2025, 1, 2), 3), ("h1", date(2025, 1, 2), 4)]
    got = views.prefer_all_hosts(spark.createDataFrame(rows, "host_id string, period date, v int"))
    assert {r["v"] for r in got.collect()} == {2, 4}


def test_latest_version_of_a_month(spark):
    rows = [("all", date(2025, 1, 1), T0, "a", 1), ("all", date(2025, 1, 1), T0 + timedelta(days=1), "a", 2)]
    df = spark.createDataFrame(rows, "host_id string, period date, modified timestamp_ntz, path string, v int")
    assert [r["v"] for r in views.latest_per_period(df).collect()] == [2]

"""Column functions and calendar helpers on hand-computed values."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netpulse.functions import exact, text, timeparts
from netpulse.operators import anomaly
from netpulse.sources.files import is_level, period_key
from netpulse.sources.logs import log_time
from netpulse.sources.normalize import from_speed_bytes, parse_local


def evaluate(spark, value, build, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(build(F.col("x")).alias("y")).head()["y"]


@pytest.mark.parametrize(
    "given,expected",
    [
        ("191.17 Mbps", 19117), ("6.58 ms", 658), ("98.4 Mbps", 9840), ("12", 1200), ("  7.5ms ", 750),
        ("n/a", None), ("", None), (None, None), ("nan", None), ("1.0d", None), ("-3.25 ms", -325),
        ("1,5 Mbps", None), ("Infinity", None), ("184.52 Mbit/s", 18452), ("5 x", 500), (".5", 50),
        ("12.345 ms", 1235), ("5x", None),
    ],
)
def test_reading(spark, given, expected):
    assert evaluate(spark, given, text.reading) == expected


@pytest.mark.parametrize(
    "num,den,expected",
    [(1, 2, 1), (-1, 2, -1), (3, 2, 2), (5, 3, 2), (4, 3, 1), (0, 5, 0), (7, 0, None), (-5, 3, -2)],
)
def test_division_rounds_half_away_from_zero(spark, num, den, expected):
    df = spark.createDataFrame([(num, den)], "a bigint, b bigint")
    assert df.select(exact.div_half_up(F.col("a"), F.col("b")).alias("y")).head()["y"] == expected


def test_hundredths_of_doubles(spark):
    for value, expected in ((0.29, 29), (1.15, 115), (2000.99, 200099), (0.57, 57), (-4.35, -435)):
        assert evaluate(spark, value, exact.hundredths, "double") == expected


@pytest.mark.parametrize(
    "parts,summary,full",
    [
        (("Net", "s1:80", "Town", "Land"), "Net – s1:80 – Town (Land)", "Net – s1:80 – Town (Land)"),
        (("Net", "", None, "Land"), "Net (Land)", "Net –  –  (Land)"),
        ((" Net ", "s1", "", ""), "Net – s1", "Net  – s1 –  ()"),
        ((None, None, None, None), "", "–  –  ()"),
    ],
)
def test_server_labels(spark, parts, summary, full):
    df = spark.createDataFrame([parts], "a string, b string, c string, d string")
    row = df.select(
        text.server_label(*[F.col(c) for c in "abcd"]).alias("s"),
        text.full_server_label(*[F.col(c) for c in "abcd"]).alias("f"),
    ).head()
    assert (row["s"], row["f"]) == (summary, full)


def test_quarter_hour_and_zone(spark):
    at = datetime(2025, 12, 29, 8, 46, 2)
    local = evaluate(spark, at, timeparts.to_local, "timestamp_ntz")
    assert local == datetime(2025, 12, 29, 14, 16, 2)
    assert evaluate(spark, local, timeparts.quarter_hour, "timestamp_ntz") == datetime(2025, 12, 29, 14, 15)
    assert evaluate(spark, datetime(2025, 1, 1, 0, 0), timeparts.quarter_hour, "timestamp_ntz") == datetime(2025, 1, 1)
    assert evaluate(spark, datetime(2025, 1, 1, 0, 59, 59), timeparts.quarter_hour, "timestamp_ntz") == datetime(2025, 1, 1, 0, 45)


def test_week_belongs_to_iso_year(spark):
    # 30 December 2024 is the Monday of the first ISO week of 2025.
    monday = evaluate(spark, datetime(2025, 1, 1, 5), lambda c: timeparts.period_of(c, "weekly"), "timestamp_ntz")
    assert str(monday) == "2024-12-30"
    assert evaluate(spark, monday, timeparts.iso_week_label, "date") == "2025W01"


def test_previous_periods():
    as_of = datetime(2026, 1, 5, 0, 10)  # a Monday
    assert timeparts.previous_period("hourly", as_of) == datetime(2026, 1, 4, 23)
    assert timeparts.previous_period("daily", as_of) == datetime(2026, 1, 4)
    assert timeparts.previous_period("weekly", as_of) == datetime(2025, 12, 29)
    assert timeparts.previous_period("monthly", as_of) == datetime(2026, 1, 1)
    assert timeparts.previous_period("monthly", datetime(2026, 2, 1, 3)) == datetime(2026, 1, 1)
    assert timeparts.previous_period("yearly", as_of) == datetime(2025, 1, 1)
    assert timeparts.previous_period("yearly", datetime(2026, 1, 8)) == datetime(2026, 1, 1)


def test_cutoffs():
    as_of = datetime(2026, 2, 18, 14, 20)  # a Wednesday
    assert timeparts.cutoff_of_last("weekly", as_of, 2, True) == datetime(2026, 2, 9)
    assert timeparts.cutoff_of_last("weekly", as_of, 2, False) == datetime(2026, 2, 2)
    assert timeparts.cutoff_of_last("monthly", as_of, 3, True) == datetime(2025, 12, 1)
    assert timeparts.cutoff_of_last("monthly", as_of, 14, False) == datetime(2024, 12, 1)
    assert timeparts.cutoff_of_last("yearly", as_of, 1, True) == datetime(2026, 1, 1)
    assert timeparts.cutoff_of_last("hourly", as_of, 3, False) == datetime(2026, 2, 18, 11)
    assert [timeparts.look_back(m, 90) for m in ("daily", "weekly", "monthly", "yearly")] == [90, 12, 3, 0]


def test_since():
    assert timeparts.parse_since("30m") == timedelta(minutes=30)
    assert timeparts.parse_since("2D") == timedelta(days=2)
    assert timeparts.parse_since("later") == timedelta(minutes=5)


@pytest.mark.parametrize(
    "connection,exact_speed,view_speed",
    [
        ("Wi-Fi 5GHz", 200, 200), ("Wi-Fi 2.4GHz", 100, 100), ("Wi-Fi (unknown band)", 200, 150),
        ("Ethernet or missing iwconfig", 200, 200), ("Unknown", 150, 150), (None, 200, 150),
        ("wi-fi 2.4ghz, Ethernet", 200, 100),
    ],
)
def test_both_threshold_rules(spark, connection, exact_speed, view_speed):
    assert evaluate(spark, connection, anomaly.expected_speed) == exact_speed
    assert evaluate(spark, connection, anomaly.view_expected_speed) == view_speed


def test_log_texts(spark):
    assert evaluate(spark, "2025-01-02T03:04:05.250000+00:00Z", log_time) == datetime(2025, 1, 2, 3, 4, 5, 250000)
    assert evaluate(spark, "2025-01-02T03:04:05Z", log_time) == datetime(2025, 1, 2, 3, 4, 5)
    assert evaluate(spark, "yesterday", log_time) is None
    assert evaluate(spark, "Completed: roll_up in 2.5s", text.completed_function) == "roll_up"
    assert evaluate(spark, "Completed successfully: roll_up", text.completed_function) == "roll_up"
    assert evaluate(spark, "Completed: roll_up in 2.5s", text.duration_in_text) == 2.5
    for message, kind in (
        ("START id", None), ("REPORT x", None), ("an Error here", "error"), ("Exception: x", "error"),
        ("WARN slow", "warning"), ("INFO ok", "info"), ("hello", "plain"),
    ):
        assert evaluate(spark, message, text.severity) == kind
    group = evaluate(spark, "/app/netpulse-dashboard-prod", lambda c: text.function_of_group(c, "netpulse-"))
    assert group == "dashboard"


def test_keys_of_paths(spark):
    base = "s/aggregated/host=h1/year=2025/"
    assert evaluate(spark, base + "month=202510/day=20251022/hour=2025102207/a.json", lambda c: period_key(c, "hourly")) == "2025-10-22 07:00"
    assert evaluate(spark, base + "month=202510/day=20251022/hour=07/a.json", lambda c: period_key(c, "hourly")) == "2025-10-22 07:00"
    assert evaluate(spark, base + "week=2025W7/a.json", lambda c: period_key(c, "weekly")) == "2025-W07"
    assert evaluate(spark, base + "month=202513/a.json", lambda c: period_key(c, "monthly")) == "Unknown"
    day = base + "month=202510/day=20251022/a.json"
    flags = {level: evaluate(spark, day, lambda c, level=level: is_level(c, level)) for level in ("hourly", "daily", "monthly", "yearly")}
    assert flags == {"hourly": False, "daily": True, "monthly": False, "yearly": False}


def test_local_stamp_and_bytes(spark):
    assert evaluate(spark, "2025-12-29 14:16:02 IST", parse_local) == datetime(2025, 12, 29, 14, 16, 2)
    assert evaluate(spark, "2025-12-29T14:16", parse_local) is None
    df = spark.createDataFrame([(23896250.0, 12300000.0, 6.579)], "download_bps double, upload_bps double, ping double")
    row = from_speed_bytes(df).head()
    assert (row["download_mbps"], row["upload_mbps"], row["ping_ms"]) == ("191.17 Mbps", "98.40 Mbps", "6.58 ms")


def test_display_text(spark):
    assert evaluate(spark, 12.3, lambda c: text.with_unit(c, " Mbps"), "double") == "12.30 Mbps"
    assert evaluate(spark, None, lambda c: text.with_unit(c, " Mbps"), "double") == "N/A"
    assert evaluate(spark, ["a", "b"], text.joined, "array<string>") == "a, b"
    assert evaluate(spark, [], text.joined, "array<string>") == "Unknown"
    assert evaluate(spark, [], text.first_or_blank, "array<string>") == ""

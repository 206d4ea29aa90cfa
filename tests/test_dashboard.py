"""Dashboard statistics on hand-computed frames."""

import ipaddress
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netpulse.operators import anomaly, compare, dashboard, rollup, views
from netpulse.plans import jobs
from netpulse.sources import tables

SCHEMA = (
    "host_id string, seq bigint, date_ist timestamp_ntz, download_avg double, upload_avg double, ping_avg double, "
    "connection_type string, top_server string, public_ip string"
)


def frame(spark, downloads, types=None, servers=None):
    start = datetime(2025, 1, 1)
    return spark.createDataFrame(
        [
            ("h", i, start + timedelta(days=i), d, (d or 0) / 2, 10.0, (types or ["Ethernet"] * len(downloads))[i],
             (servers or ["s"] * len(downloads))[i], f"10.0.{i % 2}.{i}")
            for i, d in enumerate(downloads)
        ],
        SCHEMA,
    )


def test_known_distribution(spark):
    """172 x 50, 58 x 125, 49 x 165, 285 x 190, 69 x 205: mean 145.70, median 190."""
    speeds = [50.0] * 172 + [125.0] * 58 + [165.0] * 49 + [190.0] * 285 + [205.0] * 69
    got = dashboard.speed_distribution(frame(spark, speeds)).orderBy("band").collect()
    assert [r["tests"] for r in got] == [172, 58, 49, 285, 69]
    assert (got[0]["mean"], got[0]["p50"], got[0]["p25"], got[0]["p75"]) == (145.70, 190.0, 50.0, 190.0)
    assert [r["share"] for r in got] == [27.2, 9.2, 7.7, 45.0, 10.9]


def test_two_percentiles_differ(spark):
    got = dashboard.linear_percentiles(frame(spark, [1.0, 2.0, 3.0, 4.0, 10.0])).head()
    assert (got["download_p50"], got["download_p95"]) == (3.0, 8.8)  # the summary rule gives 4 for p95


def test_trend_of_an_odd_number_of_rows(spark):
    got = dashboard.trend_halves(frame(spark, [100.0, 100.0, 150.0, 150.0, 150.0]), ["seq"]).head()
    assert (got["download_change"], got["ping_change"], got["tests_change"]) == (50.0, 0.0, 50.0)
    assert dashboard.trend_halves(frame(spark, [100.0]), ["seq"]).count() == 0
    zero = dashboard.trend_halves(frame(spark, [0.0, 5.0]), ["seq"]).head()
    assert zero["download_change"] == 0.0


def test_records_take_the_earliest_of_ties(spark):
    got = {r["record"]: r for r in dashboard.historical_records(frame(spark, [5.0, 9.0, 9.0, 5.0], servers=list("abcd"))).collect()}
    assert got["best_download"]["date_ist"] == datetime(2025, 1, 2) and got["best_download"]["server"] == "b"
    assert got["worst_download"]["date_ist"] == datetime(2025, 1, 1)
    assert got["lowest_ping"]["value"] == 10.0


def test_summary_and_flags(spark):
    view = anomaly.flag_rows(frame(spark, [100.0, 180.0, 170.0, None], types=["Wi-Fi 2.4GHz", "Ethernet, x", "Ethernet", "Unknown"], servers=["b", "a", "b", "a"]))
    rows = view.orderBy("seq").collect()
    assert [r["below_expected"] for r in rows] == [False, False, True, False]
    assert [r["download_anomaly"] for r in rows] == [True, False, False, False]  # mean 150, 70 % is 105
    got = dashboard.summary_stats(view).head()
    assert (got["avg_download"], got["total_tests"], got["below_expected"], got["top_server_over_period"]) == (150.0, 4, 1, "a")


def test_connection_statistics_and_facets(spark):
    view = frame(spark, [100.0, 200.0, 95.5], types=["Wi-Fi 2.4GHz, Ethernet", "Ethernet or missing iwconfig", "Wi-Fi (unknown band)"])
    got = {r["connection"]: r for r in dashboard.connection_stats(view).collect()}
    assert got["Ethernet"]["count"] == 2 and got["Ethernet"]["below_pct"] == 50.0
    assert got["Wi-Fi 2.4GHz"]["avg"] == 100.0 and got["Unknown"]["count"] == 1
    facets = {r["name"]: r["count"] for r in dashboard.connection_facets(view).collect()}
    assert facets == {"Wi-Fi 2.4GHz": 1, "Ethernet": 2, "Ethernet or missing iwconfig": 1}


def test_address_groups(spark):
    ips = ["1.2.3.4", "1.2.3.5", "1.2.4.1", "1.2.5.1", "9.9.9.9", " 9.9.9.9 ", "9.9.8.1", "Unknown", "n/a", "", "300.1.1.1", "fe80::1"]
    got = dashboard.cidr_groups(spark.createDataFrame([(i,) for i in ips], "public_ip string"))
    assert {(r["cidr"], r["count"]) for r in got.collect()} == {("1.2.0.0/16", 4), ("9.9.9.0/24", 1), ("9.9.8.0/24", 1), ("fe80::/24", 1)}


def test_networks_of_every_spelling_as_the_standard_library_tells_them(spark):
    good = ["::", "::1", "1::", "fe80::1%eth0", "2001:DB8::", "2001:db8:1:2:3:4:5:6", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
            "::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:1.2.3.4", "0:d00::1", "2a02:00ff::9", "1.2.3.4"]
    bad = [":", ":::", "1:2", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "::1.2.3", "::1.2.3.400", "g::", "1:2:3:4:5:6:7:8::", "::%",
           "1:2:3:4:5:6:7:", ":1:2:3:4:5:6:7", "1.2.3.4::", "::1.2.3.4:5"]
    for ip in good:
        net = ipaddress.ip_network(f"{ipaddress.ip_address(ip)}/24", strict=False)
        got = dashboard.cidr_groups(spark.createDataFrame([(ip,)], "public_ip string")).collect()
        assert [(r["cidr"], r["count"]) for r in got] == [(str(net), 1)], ip
    for ip in bad:
        with pytest.raises(ValueError):
            ipaddress.ip_address(ip)
    assert not dashboard.cidr_groups(spark.createDataFrame([(ip,) for ip in bad], "public_ip string")).collect()
    many = ["2001:100::1", "2001:200::1", "2001:300::1", "2001:300::2"]
    got = dashboard.cidr_groups(spark.createDataFrame([(ip,) for ip in many], "public_ip string"))
    assert [tuple(r) for r in got.collect()] == [("2001::/16", 4)]


def test_facets_of_many_free_names(spark):
    lists = [f"name {i}, Name {i // 7}x" for i in range(20_000)] + ["", "a,,a", "A"]
    got = {r["name"]: r["count"] for r in dashboard.connection_facets(spark.createDataFrame([(x,) for x in lists], "connection_type string")).collect()}
    assert len(got) == 20_000 + len({i // 7 for i in range(20_000)}) + 2
    assert got["name 19999"] == 1 and got["a"] == got["A"] == 20_002
    # "name 5" is in "name 5…" of both columns, whatever the case.
    assert got["name 5"] == sum("name 5" in x.lower() for x in lists)


def test_filters_combine(spark):
    view = frame(spark, [50.0, 150.0, 250.0])
    assert views.advanced_filter(view, download=(100.0, None), ip="10.0.*").count() == 2
    assert views.advanced_filter(view, ip="10.0.1.*").count() == 1
    assert views.advanced_filter(view, ip="10_0.*").count() == 0
    assert views.advanced_filter(view, threshold=150.0).count() == 1
    assert views.advanced_filter(view, connection="ETHER", start=datetime(2025, 1, 2)).count() == 2
    assert views.advanced_filter(view, connection="(").count() == 0  # text, not a pattern


def test_period_over_period(spark):
    rows = [("h", date(2025, 1, 6), 100.0, 10.0, 5.0), ("h", date(2025, 1, 13), 150.0, 5.0, None)]
    df = spark.createDataFrame(rows, "host_id string, period date, avg_download double, avg_upload double, avg_ping double")
    first, second = compare.period_over_period(df).orderBy("period").collect()
    assert first["download_change"] is None
    assert (second["download_change"], second["upload_change"], second["ping_change"]) == (50.0, -50.0, None)


def test_view_for_a_mode(spark, sf_dir):
    m = tables.measurements(spark, sf_dir)
    levels = {"minute": m, "daily": rollup.daily(m)}
    levels["weekly"] = rollup.weekly(levels["daily"])
    as_of = datetime(2024, 1, 31, 6)
    every = jobs.view_for("daily", None, levels, as_of)
    assert every.count() == 31 and {r["host_id"] for r in every.select("host_id").distinct().collect()} == {"all"}
    assert jobs.view_for("daily", 7, levels, as_of, "host-1").count() == 8  # the cut-off day counts
    assert jobs.view_for("weekly", 14, levels, as_of).count() == 2
    week = jobs.view_for("minute", 7, levels, as_of, "_legacy")
    assert week.agg(F.min("date_ist")).head()[0] >= as_of - timedelta(days=7)
    assert {"download_anomaly", "ping_anomaly", "below_expected"} <= set(week.columns)


@pytest.mark.parametrize("mode", ["minute", "daily"])
def test_bundle(spark, sf_dir, mode):
    m = tables.measurements(spark, sf_dir)
    view = views.minute_view(m).persist() if mode == "minute" else frame(spark, [float(i) for i in range(30)]).persist()
    parts = jobs.dashboard_bundle(view, mode, ["seq"])
    total = view.count()
    assert parts["rows"].count() == total
    assert parts["summary"].head()["total_tests"] == total
    for name, df in parts.items():
        assert df.limit(1).count() == 1, name
    chart = parts["chart"].groupBy("host_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert all(r["n"] <= 200 or mode == "daily" for r in chart)
    view.unpersist()

"""View, dashboard and comparison queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netpulse.catalogue import sql
from netpulse.functions import exact, text
from netpulse.operators import anomaly, compare, dashboard, rollup, views
from netpulse.sinks.tables import written
from netpulse.sources import tables

AS_OF = datetime(2024, 1, 31, 6, 0)  # local time just after the last event
LONG_AS_OF = datetime(2001, 8, 2)
METRICS = ("download", "upload", "ping")


def _minute(spark: SparkSession, sf_dir: str, look_back: int | None = None) -> DataFrame:
    return views.minute_view(tables.measurements(spark, sf_dir), AS_OF, look_back)


def _hourly(spark: SparkSession, sf_dir: str, with_ip: bool = False, look_back: int | None = None) -> DataFrame:
    m = tables.measurements(spark, sf_dir)
    ips = views.period_first_ip(m, "hourly") if with_ip else None
    return written(views.view(rollup.hourly(m), "hourly", None, AS_OF, look_back, ips), "hourly-view")


def _daily(spark: SparkSession, sf_dir: str, with_ip: bool = False) -> DataFrame:
    m = tables.measurements(spark, sf_dir)
    ips = views.period_first_ip(m, "daily") if with_ip else None
    return written(views.view(rollup.daily(m), "daily", first_ips=ips), "daily-view")


def view_minute(spark, sf_dir):
    return views.view_records(_minute(spark, sf_dir, 60)).withColumn(
        "result_urls", F.array_join("result_urls", "|")
    )


def view_hourly(spark, sf_dir):
    return views.view_records(_hourly(spark, sf_dir, True, 60))


def view_daily(spark, sf_dir):
    return views.view_records(_daily(spark, sf_dir, True))


def view_weekly(spark, sf_dir):
    weeks = rollup.weekly(rollup.daily(tables.measurements(spark, sf_dir)))
    return views.view_records(written(views.view(weeks, "weekly", None, AS_OF, 52), "weekly-view"))


def _months(spark, sf_dir):
    return rollup.monthly(rollup.daily(tables.long_series(spark, sf_dir)))


def view_monthly(spark, sf_dir):
    months = _months(spark, sf_dir)
    return views.view_records(written(views.view(months, "monthly", None, LONG_AS_OF, 120), "monthly-view"))


def view_yearly(spark, sf_dir):
    years = rollup.yearly(_months(spark, sf_dir))
    return views.view_records(written(views.view(years, "yearly", None, LONG_AS_OF, 10), "yearly-view"))


def _c(name: str) -> str:
    return sql.hundredth(name)


BELOW = """CASE WHEN contains(prim, 'wi-fi 5ghz') THEN 200 WHEN contains(prim, 'wi-fi 2.4ghz') THEN 100
  WHEN contains(prim, 'ethernet') THEN 200 WHEN contains(prim, 'unknown') THEN 150 ELSE 150 END"""

# CTE f: rows of CTE x (dl_c, ul_c, ping_c, connection_type, ...) with the three flags.
FLAGS = f"""
f AS (SELECT * EXCLUDE (prim),
    coalesce(dl_c * 10 * (SELECT count(dl_c) FROM x) < 7 * (SELECT sum(dl_c) FROM x), FALSE) AS download_anomaly,
    coalesce(ping_c * 2 * (SELECT count(ping_c) FROM x) > 3 * (SELECT sum(ping_c) FROM x), FALSE) AS ping_anomaly,
    coalesce(dl_c < 90 * {BELOW}, FALSE) AS below_expected
  FROM (SELECT *, lower(trim(split_part(connection_type, ',', 1))) AS prim FROM x))"""

AVGS = f"{_c('dl_c')} AS download_avg, {_c('ul_c')} AS upload_avg, {_c('ping_c')} AS ping_avg"

X_MINUTE = """
x AS (SELECT seq, local_ts AS date_ist, strftime(local_ts, '%Y-%m-%d %H:%M') AS date_ist_str, download_c AS dl_c,
    upload_c AS ul_c, ping_c, server_name || ' – ' || server_host || ' – ' || server_city || ' (' || server_country || ')'
    AS top_server, public_ip, coalesce(connection_type, 'Unknown') AS connection_type,
    coalesce(wifi_name, '') AS wifi_name, result_url AS result_urls, host_id, host_name, host_location, host_isp
  FROM v)"""
X_MINUTE_60 = X_MINUTE.replace("FROM v)", "FROM v WHERE local_ts >= TIMESTAMP '2024-01-31 06:00:00' - INTERVAL 60 DAY)")


def _x_period(level: str) -> str:
    label = "'%Y-%m-%d %H:00'" if level == "hourly" else "'%Y-%m-%d'"
    return f"""
ips AS (SELECT period, min(public_ip) AS public_ip FROM good WHERE host_id = 'all' AND public_ip <> '' GROUP BY period),
x AS (SELECT s.period AS date_ist, strftime(s.period, {label}) AS date_ist_str, download_avg_c AS dl_c,
    upload_avg_c AS ul_c, ping_avg_c AS ping_c,
    CASE WHEN connection_types = '' THEN 'Unknown' ELSE replace(connection_types, '|', ', ') END AS connection_type,
    split_part(servers_top, '|', 1) AS top_server, coalesce(ips.public_ip, '') AS public_ip, records,
    {sql.tenth('completion_d')} AS completion_rate, host_id
  FROM s LEFT JOIN ips USING (period) WHERE host_id = 'all')"""


def _x_coarse(source: str, label: str, count: str) -> str:
    return f"""
x AS (SELECT period AS date_ist, {label} AS date_ist_str, dl_c, ul_c, ping_c,
    CASE WHEN len(types) = 0 THEN 'Unknown' ELSE array_to_string(types, ', ') END AS connection_type,
    '' AS top_server, '' AS public_ip, n AS {count}, host_id FROM {source} WHERE host_id = 'all')"""


MINUTE = sql.with_(sql.M, X_MINUTE, FLAGS)
HOURLY = sql.with_(sql.M, sql.summary("hourly"), _x_period("hourly"), FLAGS)
DAILY = sql.with_(sql.M, sql.summary("daily"), _x_period("daily"), FLAGS)
WEEKS = (sql.M, sql.DAY_MEANS, sql.coarser("d", "weekly", "w"))
MONTHS = (sql.O, sql.DAY_MEANS, sql.coarser("d", "monthly", "mo"))
YEARS = (*MONTHS, sql.coarser("mo", "yearly", "y"))
WEEKLY = sql.with_(
    *WEEKS,
    _x_coarse("w", "strftime(period, '%Y-%m-%d') || ' to ' || strftime(period + INTERVAL 6 DAY, '%Y-%m-%d')", "days"),
    FLAGS,
)
MONTHLY = sql.with_(*MONTHS, _x_coarse("mo", "strftime(period, '%Y-%m')", "days"), FLAGS)
YEARLY = sql.with_(*YEARS, _x_coarse("y", "strftime(period, '%Y')", "months"), FLAGS)
ALL = f"SELECT * EXCLUDE (dl_c, ul_c, ping_c), {AVGS} FROM f"


def below_expected_periods(spark, sf_dir):
    months = views.view(_months(spark, sf_dir), "monthly")
    return dashboard.below_expected_periods(anomaly.flag_below_expected(months))


BELOW_PERIODS_SQL = (
    MONTHLY
    + "SELECT count(*) FILTER (WHERE b) AS below_expected, count(*) AS total_days "
    + "FROM (SELECT date_ist, bool_or(below_expected) AS b FROM f GROUP BY date_ist)"
)


def advanced_filter(spark, sf_dir):
    return views.advanced_filter(
        _minute(spark, sf_dir),
        start=datetime(2024, 1, 5),
        end=datetime(2024, 1, 25, 12),
        download=(20.0, 400.0),
        upload=(15.5, None),
        ping=(None, 80.0),
        connection="wi-fi",
        isp="ISP-1",
        ip="10.*",
        threshold=300.0,
    ).select("seq", "date_ist", "download_avg", "upload_avg", "ping_avg", "connection_type", "host_isp", "public_ip")


ADVANCED_SQL = (
    MINUTE
    + f"""SELECT seq, date_ist, {AVGS}, connection_type, host_isp, public_ip FROM f
WHERE date_ist >= '2024-01-05' AND date_ist <= TIMESTAMP '2024-01-25 12:00:00' AND dl_c BETWEEN 2000 AND 40000
  AND ul_c >= 1550 AND ping_c <= 8000 AND lower(connection_type) LIKE '%wi-fi%' AND lower(host_isp) LIKE '%isp-1%'
  AND public_ip LIKE '10.%' AND dl_c < 30000"""
)


def row_anomalies(spark, sf_dir):
    return anomaly.flag_rows(_minute(spark, sf_dir)).select("seq", "download_anomaly", "ping_anomaly")


def below_expected(spark, sf_dir):
    return anomaly.flag_below_expected(_hourly(spark, sf_dir)).select(
        "date_ist", "connection_type", "download_avg", "below_expected"
    )


def summary_stats(spark, sf_dir):
    return dashboard.summary_stats(anomaly.flag_below_expected(_minute(spark, sf_dir)))


SUMMARY_SQL = (
    MINUTE
    + f"""SELECT {_c(sql.mean('dl_c'))} AS avg_download, {_c(sql.mean('ul_c'))} AS avg_upload,
  {_c(sql.mean('ping_c'))} AS avg_ping, count(*) AS total_tests,
  count(*) FILTER (WHERE below_expected) AS below_expected,
  (SELECT top_server FROM f GROUP BY top_server ORDER BY count(*) DESC, top_server LIMIT 1) AS top_server_over_period
FROM f"""
)


def linear_percentiles(spark, sf_dir):
    return dashboard.linear_percentiles(_minute(spark, sf_dir))


def _linear(c: str, p: float) -> str:
    return (
        f"round(CAST(quantile_cont(CAST({c} AS DOUBLE), {p}::DOUBLE) AS DECIMAL(28, 6)), 0) / 100::DOUBLE"
    )


_SHORT = {"download": "dl_c", "upload": "ul_c", "ping": "ping_c"}
PERCENTILE_SQL = (
    MINUTE
    + "SELECT "
    + ", ".join(f"{_linear(c, p / 100)} AS {m}_p{p}" for m, c in _SHORT.items() for p in (50, 95, 99))
    + " FROM x"
)


def trend_halves(spark, sf_dir):
    return dashboard.trend_halves(_minute(spark, sf_dir), ["seq"])


def _change(c: str) -> str:
    now, before = f"sum({c}) FILTER (WHERE now)", f"sum({c}) FILTER (WHERE NOT now)"
    n_now, n_before = f"count({c}) FILTER (WHERE now)", f"count({c}) FILTER (WHERE NOT now)"
    return sql.half_up(f"1000 * ({now} * {n_before} - {before} * {n_now})", f"{before} * {n_now}")


TREND_SQL = (
    MINUTE
    + ", ".join(["SELECT " + f"{sql.tenth(_change('dl_c'))} AS download_change"]
                + [f"{sql.tenth(_change(_SHORT[m]))} AS {m}_change" for m in ("upload", "ping")])
    + f""", {sql.tenth(sql.half_up('1000 * (count(*) FILTER (WHERE now) - count(*) FILTER (WHERE NOT now))', 'count(*) FILTER (WHERE NOT now)'))} AS tests_change
FROM (SELECT *, row_number() OVER (ORDER BY date_ist, seq) > (SELECT count(*) // 2 FROM x) AS now FROM x)"""
)


def historical_records(spark, sf_dir):
    return dashboard.historical_records(_daily(spark, sf_dir))


RECORDS_SQL = DAILY + " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{name}' AS record, {_c(c)} AS value, CAST(date_ist AS VARCHAR) AS date_ist,
  {'top_server' if name == 'best_download' else 'NULL'} AS server FROM x ORDER BY {c} {order}, x.date_ist LIMIT 1)"""
    for name, c, order in (
        ("best_download", "dl_c", "DESC"),
        ("worst_download", "dl_c", "ASC"),
        ("best_upload", "ul_c", "DESC"),
        ("lowest_ping", "ping_c", "ASC"),
    )
)


def connection_stats(spark, sf_dir):
    return dashboard.connection_stats(_hourly(spark, sf_dir))


CONNECTION_STATS_SQL = (
    HOURLY
    + f"""SELECT connection, count(*) AS count,
  CAST({sql.half_up('sum(dl_c)', 'count(dl_c) * 10')} AS BIGINT) / 10::DOUBLE AS avg, threshold, min_threshold,
  count(*) FILTER (WHERE dl_c < min_threshold * 100) AS below_min,
  CAST({sql.half_up('1000 * count(*) FILTER (WHERE dl_c < min_threshold * 100)', 'count(*)')} AS BIGINT) / 10::DOUBLE AS below_pct
FROM x JOIN (VALUES ('Ethernet', 200, 180), ('Wi-Fi 5GHz', 200, 180), ('Wi-Fi 2.4GHz', 100, 90), ('Unknown', 150, 135))
  t(connection, threshold, min_threshold) ON contains(lower(connection_type), lower(connection))
GROUP BY connection, threshold, min_threshold"""
)


def connection_facets(spark, sf_dir):
    return dashboard.connection_facets(_hourly(spark, sf_dir))


FACETS_SQL = (
    HOURLY
    + """SELECT name, count(*) AS count FROM (
  SELECT DISTINCT trim(p) AS name FROM (SELECT unnest(string_split(connection_type, ',')) AS p FROM x)) names
JOIN x ON contains(lower(connection_type), lower(name))
WHERE name <> '' AND name <> 'Wi-Fi (unknown band)' GROUP BY name"""
)


def isp_facets(spark, sf_dir):
    return dashboard.isp_facets(_minute(spark, sf_dir))


def quick_filter_counts(spark, sf_dir):
    return dashboard.quick_filter_counts(_minute(spark, sf_dir))


def cidr_groups(spark, sf_dir):
    return dashboard.cidr_groups(_minute(spark, sf_dir))


CIDR_SQL = (
    MINUTE
    + r""", ip AS (SELECT DISTINCT trim(public_ip) AS ip FROM x WHERE regexp_full_match(trim(public_ip), '\d+\.\d+\.\d+\.\d+')),
n AS (SELECT ip, regexp_extract(ip, '^\d+\.\d+') AS a, regexp_extract(ip, '^\d+\.\d+\.\d+') AS b FROM ip),
k AS (SELECT a, count(DISTINCT b) AS blocks FROM n GROUP BY a)
SELECT CASE WHEN blocks >= 3 THEN a || '.0.0/16' ELSE b || '.0/24' END AS cidr, count(*) AS count
FROM n JOIN k USING (a) GROUP BY 1"""
)


def cidr_groups_ipv6(spark, sf_dir):
    """Addresses whose last number is odd written as IPv6: some in full, some with ``::``, some with an IPv4 end."""
    ip = F.trim("public_ip")
    a, b, c, d = (F.split_part(ip, F.lit("."), F.lit(i)).cast("int") for i in range(1, 5))
    front = F.format_string("20%02x:%x%02x", a, b, c)
    spelled = (
        F.when(d % 6 == 1, F.concat(front, F.format_string(":0:0:0:0:0:%X", d)))
        .when(d % 6 == 3, F.concat(front, F.format_string("::%x", d)))
        .when(d % 6 == 5, F.concat(F.lit("::"), ip))
        .otherwise(ip)
    )
    rows = _minute(spark, sf_dir)
    return dashboard.cidr_groups(rows.select(F.when(ip.rlike(text.IPV4), spelled).otherwise(ip).alias("public_ip")))


CIDR_IPV6_SQL = (
    MINUTE
    + r""", ip AS (SELECT DISTINCT trim(public_ip) AS ip FROM x WHERE regexp_full_match(trim(public_ip), '\d+\.\d+\.\d+\.\d+')),
p AS (SELECT ip, list_transform(string_split(ip, '.'), lambda v: v::INT) AS g FROM ip),
n AS (SELECT CASE WHEN g[4] % 6 IN (1, 3) THEN format('20{:02x}::/16', g[1]) WHEN g[4] % 6 = 5 THEN '::/16'
      ELSE regexp_extract(ip, '^\d+\.\d+') || '.0.0/16' END AS a,
    CASE WHEN g[4] % 6 IN (1, 3) THEN CASE WHEN g[2] = 0 THEN format('20{:02x}::/24', g[1])
        ELSE format('20{:02x}:{:x}00::/24', g[1], g[2]) END
      WHEN g[4] % 6 = 5 THEN '::/24' ELSE regexp_extract(ip, '^\d+\.\d+\.\d+') || '.0/24' END AS b FROM p),
k AS (SELECT a, count(DISTINCT b) AS blocks FROM n GROUP BY a)
SELECT CASE WHEN blocks >= 3 THEN a ELSE b END AS cidr, count(*) AS count FROM n JOIN k USING (a) GROUP BY 1"""
)


def speed_distribution(spark, sf_dir):
    return dashboard.speed_distribution(_minute(spark, sf_dir))


DISTRIBUTION_SQL = (
    MINUTE
    + f"""SELECT CASE WHEN dl_c < 10000 THEN '1: < 100' WHEN dl_c < 15000 THEN '2: 100-150'
    WHEN dl_c < 18000 THEN '3: 150-180' WHEN dl_c < 20000 THEN '4: 180-200' ELSE '5: >= 200' END AS band,
  count(*) AS tests, CAST({sql.half_up('1000 * count(*)', '(SELECT count(dl_c) FROM x)')} AS BIGINT) / 10::DOUBLE AS share,
  {_c(f"(SELECT {sql.mean('dl_c')} FROM x)")} AS mean,
  {', '.join(f"(SELECT {_linear('dl_c', p / 100)} FROM x) AS p{p}" for p in (25, 50, 75))},
  {_c('(SELECT min(dl_c) FROM x)')} AS min, {_c('(SELECT max(dl_c) FROM x)')} AS max
FROM x GROUP BY band"""
)


def host_comparison(spark, sf_dir):
    return compare.hosts(tables.measurements(spark, sf_dir))


def hour_of_day(spark, sf_dir):
    return compare.hour_of_day(tables.measurements(spark, sf_dir))


_MEANS = f"""{_c(sql.mean('download_c'))} AS avg_download, {_c(sql.mean('upload_c'))} AS avg_upload,
  {_c(sql.mean('ping_c'))} AS avg_ping"""


def week_over_week(spark, sf_dir):
    days = rollup.period_means(tables.measurements(spark, sf_dir), "daily")
    return compare.period_over_period(rollup.coarser(days, "weekly"))


def month_over_month(spark, sf_dir):
    days = rollup.period_means(tables.long_series(spark, sf_dir), "daily")
    return compare.period_over_period(rollup.coarser(days, "monthly"))


def _over(ctes: tuple, source: str) -> str:
    def change(c: str) -> str:
        return sql.tenth(sql.half_up(f"1000 * ({c} - {c}_p)", f"{c}_p"))

    return sql.dated(
        sql.with_(*ctes)
        + f"""SELECT host_id, period, {_c('dl_c')} AS avg_download, {_c('ul_c')} AS avg_upload, {_c('ping_c')} AS avg_ping,
  {change('dl_c')} AS download_change, {change('ul_c')} AS upload_change, {change('ping_c')} AS ping_change
FROM (SELECT *, lag(dl_c) OVER w AS dl_c_p, lag(ul_c) OVER w AS ul_c_p, lag(ping_c) OVER w AS ping_c_p
  FROM {source} WINDOW w AS (PARTITION BY host_id ORDER BY period))""",
        "period",
    )


def latest_n(spark, sf_dir):
    return views.latest_measurements(tables.measurements(spark, sf_dir), 10).select(
        "seq", "ts", "host_id", *[exact.from_hundredths(F.col(f"{m}_c")).alias(m) for m in METRICS]
    )


def latest_periods(spark, sf_dir):
    days = rollup.daily(tables.measurements(spark, sf_dir)).select(
        "period", "host_id", "records", F.col("overall.download_mbps.avg").alias("avg_download")
    )
    return views.latest_periods(written(days, "daily"), 7)


LATEST_PERIODS_SQL = sql.dated(
    sql.with_(sql.M, sql.DAY_MEANS)
    + f"SELECT period, host_id, records, {_c('dl_c')} AS avg_download FROM d WHERE host_id = 'all' ORDER BY period DESC LIMIT 7",
    "period",
)


def latest_per_month(spark, sf_dir):
    """Months written twice: a first run and a later one; the later one counts."""
    months = written(_months(spark, sf_dir).select("host_id", "period", "avg_download"), "monthly")
    path = F.concat_ws("/", F.lit("monthly"), "host_id", F.col("period").cast("string"))

    def version(when: datetime, add: float) -> DataFrame:
        return months.select(
            "host_id",
            "period",
            (F.col("avg_download") + add).alias("avg_download"),
            F.lit(when).cast("timestamp_ntz").alias("modified"),
            path.alias("path"),
        )

    both = version(datetime(2001, 8, 1), 0.0).unionByName(version(datetime(2001, 8, 2), 1000.0))
    return views.latest_per_period(both).select("host_id", "period", "modified", "avg_download")


LATEST_MONTH_SQL = sql.dated(
    sql.with_(*MONTHS)
    + f"SELECT host_id, period, TIMESTAMP '2001-08-02 00:00:00' AS modified, {_c('dl_c')} + 1000 AS avg_download FROM mo",
    "period",
)


QUERIES = {
    "view_minute": view_minute,
    "view_hourly": view_hourly,
    "view_daily": view_daily,
    "view_weekly": view_weekly,
    "view_monthly": view_monthly,
    "view_yearly": view_yearly,
    "advanced_filter": advanced_filter,
    "row_anomalies": row_anomalies,
    "below_expected": below_expected,
    "below_expected_periods": below_expected_periods,
    "summary_stats": summary_stats,
    "linear_percentiles": linear_percentiles,
    "trend_halves": trend_halves,
    "historical_records": historical_records,
    "connection_stats": connection_stats,
    "connection_facets": connection_facets,
    "isp_facets": isp_facets,
    "quick_filter_counts": quick_filter_counts,
    "cidr_groups": cidr_groups,
    "cidr_groups_ipv6": cidr_groups_ipv6,
    "speed_distribution": speed_distribution,
    "host_comparison": host_comparison,
    "hour_of_day": hour_of_day,
    "week_over_week": week_over_week,
    "month_over_month": month_over_month,
    "latest_n": latest_n,
    "latest_periods": latest_periods,
    "latest_per_month": latest_per_month,
}
ORACLES = {
    "view_minute": sql.with_(sql.M, X_MINUTE_60, FLAGS) + ALL,
    "view_hourly": HOURLY + ALL,
    "view_daily": sql.dated(DAILY + ALL, "date_ist"),
    "view_weekly": sql.dated(WEEKLY + ALL, "date_ist"),
    "view_monthly": sql.dated(MONTHLY + ALL, "date_ist"),
    "view_yearly": sql.dated(YEARLY + ALL, "date_ist"),
    "advanced_filter": ADVANCED_SQL,
    "row_anomalies": MINUTE + "SELECT seq, download_anomaly, ping_anomaly FROM f",
    "below_expected": HOURLY
    + f"SELECT date_ist, connection_type, {_c('dl_c')} AS download_avg, below_expected FROM f",
    "below_expected_periods": BELOW_PERIODS_SQL,
    "summary_stats": SUMMARY_SQL,
    "linear_percentiles": PERCENTILE_SQL,
    "trend_halves": TREND_SQL,
    "historical_records": RECORDS_SQL,
    "connection_stats": CONNECTION_STATS_SQL,
    "connection_facets": FACETS_SQL,
    "isp_facets": MINUTE + "SELECT host_isp AS name, count(*) AS count FROM x GROUP BY host_isp",
    "quick_filter_counts": MINUTE
    + """SELECT count(*) FILTER (WHERE dl_c < 20000) AS below_threshold,
  count(*) FILTER (WHERE dl_c < 10000) AS performance_drops, count(*) FILTER (WHERE ping_c > 2000) AS high_ping FROM x""",
    "cidr_groups": CIDR_SQL,
    "cidr_groups_ipv6": CIDR_IPV6_SQL,
    "speed_distribution": DISTRIBUTION_SQL,
    "host_comparison": sql.with_(sql.M)
    + f"SELECT host_id, count(*) AS records, {_MEANS} FROM v GROUP BY host_id",
    "hour_of_day": sql.with_(sql.M)
    + f"SELECT CAST(hour(local_ts) AS INTEGER) AS hour, count(*) AS records, {_MEANS} FROM v GROUP BY 1",
    "week_over_week": _over(WEEKS, "w"),
    "month_over_month": _over(MONTHS, "mo"),
    "latest_n": sql.with_(sql.M)
    + f"SELECT seq, ts, host_id, {_c('download_c')} AS download, {_c('upload_c')} AS upload, {_c('ping_c')} AS ping FROM m ORDER BY ts DESC, seq DESC LIMIT 10",
    "latest_periods": LATEST_PERIODS_SQL,
    "latest_per_month": LATEST_MONTH_SQL,
}

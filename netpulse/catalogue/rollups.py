"""Normalising and roll-up queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netpulse.catalogue import sql
from netpulse.functions import exact, text, timeparts
from netpulse.operators import rollup
from netpulse.sources import tables
from netpulse.sources.normalize import is_plausible, is_valid, normalize

STATS = ("avg", "median", "max", "min", "p99", "p95", "p90", "p50")
METRIC = {"download": "download_mbps", "upload": "upload_mbps", "ping": "ping_ms"}


def flat(summary: DataFrame) -> DataFrame:
    return summary.select(
        "host_id",
        "period",
        "records",
        "completion_rate",
        "errors",
        *[
            F.col(f"overall.{field}.{stat}").alias(f"{name}_{stat}")
            for name, field in METRIC.items()
            for stat in STATS
        ],
        F.array_join("servers_top", "|").alias("servers_top"),
        F.array_join("connection_types", "|").alias("connection_types"),
        "threshold_mbps",
        F.array_join("anomalies", "; ").alias("anomalies"),
    )


def flat_sql(level: str) -> str:
    stats = ", ".join(f"{sql.hundredth(f'{m}_{s}_c')} AS {m}_{s}" for m in METRIC for s in STATS)
    return (
        sql.with_(sql.M, sql.summary(level), sql.messages(level))
        + f"""SELECT host_id, period, records, {sql.tenth('completion_d')} AS completion_rate, errors, {stats},
  servers_top, connection_types, threshold_mbps, anomalies FROM s JOIN a USING (host_id, period)"""
    )


def normalize_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = normalize(tables.raw_measurements(spark, sf_dir))
    return m.select(
        "seq",
        "host_id",
        F.date_trunc("second", "local_ts").cast("timestamp_ntz").alias("local_ts"),
        "bucket_start",
        exact.from_hundredths(F.col("download_c")).alias("download_mbps"),
        exact.from_hundredths(F.col("upload_c")).alias("upload_mbps"),
        exact.from_hundredths(F.col("ping_c")).alias("ping_ms"),
        "server_label",
        text.is_web_url(F.col("result_url")).alias("has_url"),
        text.is_known_ip(F.col("public_ip")).alias("has_ip"),
        is_valid().alias("valid"),
        F.coalesce(is_valid() & is_plausible(), F.lit(False)).alias("plausible"),
    )


NORMALIZE_SQL = (
    sql.with_(sql.M)
    + f"""SELECT seq, host_id, date_trunc('second', local_ts) AS local_ts, bucket_start,
  {sql.hundredth('download_c')} AS download_mbps, {sql.hundredth('upload_c')} AS upload_mbps,
  {sql.hundredth('ping_c')} AS ping_ms, server_label, result_url LIKE 'http%' AS has_url,
  lower(trim(public_ip)) NOT IN ('', 'unknown', 'n/a') AS has_ip,
  download_c IS NOT NULL AND upload_c IS NOT NULL AS valid,
  coalesce(download_c >= 100 AND upload_c >= 100 AND coalesce(ping_c <= 500000, TRUE), FALSE) AS plausible
FROM m"""
)


def hourly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(rollup.hourly(tables.measurements(spark, sf_dir)))


def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(rollup.daily(tables.measurements(spark, sf_dir)))


def _top(column: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        days = rollup.daily(tables.measurements(spark, sf_dir))
        return days.select("host_id", "period", F.posexplode(column).alias("pos", "item")).select(
            "host_id", "period", (F.col("pos") + 1).alias("rank"), "item"
        )

    return run


def _top_sql(column: str, k: int) -> str:
    return (
        sql.with_(sql.M)
        + f"""SELECT host_id, period, CAST(rank AS INTEGER) AS rank, item FROM (
  SELECT h.host AS host_id, CAST(bucket_start AS DATE) AS period, {column} AS item,
    row_number() OVER (PARTITION BY h.host, CAST(bucket_start AS DATE) ORDER BY count(*) DESC, min(seq)) AS rank
  FROM v, LATERAL (SELECT unnest([v.host_id, 'all']) AS host) h WHERE {column} <> ''
  GROUP BY h.host, CAST(bucket_start AS DATE), {column})
WHERE rank <= {k}"""
    )


def daily_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.members(tables.measurements(spark, sf_dir), "daily")


SETS_SQL = (
    sql.with_(sql.M)
    + """SELECT h.host AS host_id, CAST(bucket_start AS DATE) AS period, i.kind, i.item,
  count(*) AS n, min(seq) AS first_seq
FROM v, LATERAL (SELECT unnest([v.host_id, 'all']) AS host) h, LATERAL (
  SELECT 'host' AS kind, v.host_id AS item UNION ALL SELECT 'ip', v.public_ip
  UNION ALL SELECT 'connection', v.connection_type
  UNION ALL SELECT 'url', CASE WHEN v.result_url LIKE 'http%' THEN v.result_url END) i
WHERE i.item <> '' GROUP BY ALL"""
)


def daily_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of the daily summaries as rows: item, and for urls the place by arrival (others: -1, in order of text)."""
    members = rollup.members(tables.measurements(spark, sf_dir), "daily")
    lists = members.where(F.col("kind").isin("host", "ip", "url"))
    place = F.when(F.col("kind") == "url", F.col("first_seq")).otherwise(F.lit(-1)).alias("place")
    return lists.select("host_id", "period", "kind", "item", place)


LISTS_SQL = (
    sql.with_(sql.M)
    + """SELECT h.host AS host_id, CAST(bucket_start AS DATE) AS period, i.kind, i.item,
  CAST(min(CASE WHEN i.kind = 'url' THEN seq ELSE -1 END) AS BIGINT) AS place
FROM v, LATERAL (SELECT unnest([v.host_id, 'all']) AS host) h, LATERAL (
  SELECT 'host' AS kind, v.host_id AS item UNION ALL SELECT 'ip', v.public_ip
  UNION ALL SELECT 'url', CASE WHEN v.result_url LIKE 'http%' THEN v.result_url END) i
WHERE i.item <> '' GROUP BY ALL"""
)


def weekly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = rollup.weekly(rollup.daily(tables.measurements(spark, sf_dir)))
    return weeks.select(
        "host_id",
        "period",
        "week_end",
        timeparts.iso_week_label(F.col("period")).alias("week_label"),
        "days",
        "avg_download",
        "avg_upload",
        "avg_ping",
        F.array_join("connection_types", "|").alias("connection_types"),
    )


_MEANS_SQL = f"""{sql.hundredth('dl_c')} AS avg_download, {sql.hundredth('ul_c')} AS avg_upload,
  {sql.hundredth('ping_c')} AS avg_ping, array_to_string(types, '|') AS connection_types"""

WEEKLY_SQL = (
    sql.with_(sql.M, sql.DAY_MEANS, sql.coarser("d", "weekly", "w"))
    + f"""SELECT host_id, period, CAST(period + INTERVAL 6 DAY AS DATE) AS week_end,
  isoyear(period) || 'W' || lpad(CAST(weekofyear(period) AS VARCHAR), 2, '0') AS week_label,
  n AS days, {_MEANS_SQL} FROM w"""
)


def _coarse(df: DataFrame, count: str) -> DataFrame:
    return df.select(
        "host_id",
        "period",
        count,
        "avg_download",
        "avg_upload",
        "avg_ping",
        F.array_join("connection_types", "|").alias("connection_types"),
    )


def monthly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coarse(rollup.monthly(rollup.daily(tables.long_series(spark, sf_dir))), "days")


def yearly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = rollup.monthly(rollup.daily(tables.long_series(spark, sf_dir)))
    return _coarse(rollup.yearly(months), "months_aggregated")


MONTHLY_SQL = (
    sql.with_(sql.O, sql.DAY_MEANS, sql.coarser("d", "monthly", "mo"))
    + f"SELECT host_id, period, n AS days, {_MEANS_SQL} FROM mo"
)
YEARLY_SQL = (
    sql.with_(sql.O, sql.DAY_MEANS, sql.coarser("d", "monthly", "mo"), sql.coarser("mo", "yearly", "y"))
    + f"SELECT host_id, period, n AS months_aggregated, {_MEANS_SQL} FROM y"
)


def rollup_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.run_report(rollup.daily(tables.measurements(spark, sf_dir)))


RUN_REPORT_SQL = (
    sql.with_(sql.M, sql.summary("daily"), sql.messages("daily"))
    + """SELECT period, count(*) FILTER (WHERE host_id <> 'all') AS hosts_aggregated,
  CAST(sum(records) FILTER (WHERE host_id <> 'all') AS BIGINT) AS host_records,
  CAST(sum(records) FILTER (WHERE host_id = 'all') AS BIGINT) AS total_records,
  CAST(sum(CASE WHEN anomalies = '' THEN 0 ELSE len(string_split(anomalies, '; ')) END)
    FILTER (WHERE host_id = 'all') AS BIGINT) AS anomalies
FROM s JOIN a USING (host_id, period) GROUP BY period"""
)


def period_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = rollup.hourly(tables.measurements(spark, sf_dir))
    return hours.select(
        "host_id",
        "period",
        "threshold_mbps",
        F.posexplode("anomalies").alias("pos", "message"),
    )


PERIOD_ANOMALIES_SQL = (
    sql.with_(sql.M, sql.summary("hourly"), sql.messages("hourly"))
    + """SELECT host_id, period, threshold_mbps, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS message FROM (
  SELECT host_id, period, threshold_mbps, string_split(anomalies, '; ') AS parts
  FROM s JOIN a USING (host_id, period) WHERE anomalies <> ''),
LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) x"""
)


def low_data_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.completeness(tables.measurements(spark, sf_dir), "daily")


LOW_DATA_SQL = (
    sql.with_(sql.M)
    + """SELECT host_id, period, records, errors, records < 76.8 AS low_data, errors > 5 AS high_errors FROM (
  SELECT h.host AS host_id, CAST(bucket_start AS DATE) AS period, count(download_c) AS records,
    count(*) - count(download_c) AS errors
  FROM m, LATERAL (SELECT unnest([m.host_id, 'all']) AS host) h GROUP BY ALL) WHERE records > 0"""
)


QUERIES = {
    "normalize_measurements": normalize_measurements,
    "hourly_rollup": hourly_rollup,
    "daily_rollup": daily_rollup,
    "daily_top_servers": _top("servers_top"),
    "daily_top_connections": _top("connection_types"),
    "daily_sets": daily_sets,
    "daily_lists": daily_lists,
    "weekly_rollup": weekly_rollup,
    "monthly_rollup": monthly_rollup,
    "yearly_rollup": yearly_rollup,
    "rollup_run_report": rollup_run_report,
    "period_anomalies": period_anomalies,
    "low_data_warnings": low_data_warnings,
}
ORACLES = {
    "normalize_measurements": NORMALIZE_SQL,
    "hourly_rollup": flat_sql("hourly"),
    "daily_rollup": sql.dated(flat_sql("daily"), "period"),
    "daily_top_servers": sql.dated(_top_sql("server_label", 5), "period"),
    "daily_top_connections": sql.dated(_top_sql("connection_type", 3), "period"),
    "daily_sets": sql.dated(SETS_SQL, "period"),
    "daily_lists": sql.dated(LISTS_SQL, "period"),
    "weekly_rollup": sql.dated(WEEKLY_SQL, "period", "week_end"),
    "monthly_rollup": sql.dated(MONTHLY_SQL, "period"),
    "yearly_rollup": sql.dated(YEARLY_SQL, "period"),
    "rollup_run_report": sql.dated(RUN_REPORT_SQL, "period"),
    "period_anomalies": PERIOD_ANOMALIES_SQL,
    "low_data_warnings": sql.dated(LOW_DATA_SQL, "period"),
}

"""Scheduled runs, backfills, stored tables and documents of the levels that the other modules leave out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpulse import session
from netpulse.catalogue import sql
from netpulse.operators import quality, retention, rollup, validate
from netpulse.plans import jobs
from netpulse.sinks import tables as sinks
from netpulse.sources import tables

AS_OF = datetime(2024, 1, 31, 6, 0)  # local time just after the last event
YEAR_AS_OF = datetime(2001, 8, 2)
RETENTION_AS_OF = datetime(2024, 4, 15)

_HOUR_MEANS = sql.DAY_MEANS.replace("CAST(bucket_start AS DATE)", sql.PERIOD["hourly"])
_MEANS = ", ".join(f"{sql.hundredth(c)} AS avg_{m}" for c, m in (("dl_c", "download"), ("ul_c", "upload"), ("ping_c", "ping")))


def _levels(spark, sf_dir) -> dict[str, DataFrame]:
    """Summaries of every level over the measurements."""
    m = tables.measurements(spark, sf_dir)
    days = sinks.written(rollup.daily(m), "daily")
    months = sinks.written(rollup.monthly(days), "monthly")
    return {
        "hourly": rollup.hourly(m),
        "daily": days,
        "weekly": rollup.weekly(days),
        "monthly": months,
        "yearly": rollup.yearly(months),
    }


def _all_levels_sql(columns: str) -> str:
    """``columns`` of every level; ``n`` counts what a summary holds."""
    parts = {"hourly": "h", "daily": "d", "weekly": "w", "monthly": "mo", "yearly": "y"}
    rows = " UNION ALL ".join(
        f"SELECT '{level}' AS level, host_id, CAST(period AS TIMESTAMP) AS period, "
        f"{'records' if level in ('hourly', 'daily') else 'n'} AS n, dl_c, ul_c, ping_c FROM {cte}"
        for level, cte in parts.items()
    )
    hours = _HOUR_MEANS.replace("fan AS", "hour_fan AS").replace("types AS (", "hour_types AS (", 1)
    hours = hours.replace("FROM fan LEFT JOIN types", "FROM hour_fan LEFT JOIN hour_types").replace("FROM fan WHERE", "FROM hour_fan WHERE")
    hours = hours.replace("\nd AS (", "\nh AS (")
    ctes = sql.with_(
        sql.M, hours, sql.DAY_MEANS, sql.coarser("d", "weekly", "w"), sql.coarser("d", "monthly", "mo"), sql.coarser("mo", "yearly", "y")
    )
    return ctes + f"SELECT {columns} FROM ({rows})"


def own_documents_valid(spark, sf_dir):
    """The documents written for each level, held against the level's own rules."""
    out = None
    for level, rows in _levels(spark, sf_dir).items():
        docs = sinks.as_documents(rows, level).select(F.concat_ws("/", "host_id", F.col("period").cast("string")).alias("key"), "doc")
        counted = validate.validate(docs, level, 2024).groupBy("level").agg(
            F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("valid")).alias("invalid")
        )
        out = counted if out is None else out.unionByName(counted)
    return out


def summary_tables(spark, sf_dir):
    """Every level written by partition, written again, and read back."""
    out = None
    for level, rows in _levels(spark, sf_dir).items():
        folder = session.fresh_folder(spark, f"{level}-table")
        kept = rollup.as_period_means(rows, "records") if level in ("hourly", "daily") else rows
        kept = sinks.written(kept, level)
        for _ in range(2):
            sinks.write_summaries(kept, level, folder)
        back = sinks.read_summaries(spark, folder)
        part = back.select(
            F.lit(level).alias("level"), "host_id", F.col("period").cast("timestamp_ntz").alias("period"),
            F.col(rollup.COUNT_NAME.get(level, "records")).alias("n"), "avg_download", "avg_upload", "avg_ping",
        )
        out = part if out is None else out.unionByName(part)
    return out


def scheduled_hour(spark, sf_dir):
    """What the hourly run at the as-of moment builds."""
    hour = jobs.run("hourly", tables.measurements(spark, sf_dir), AS_OF)
    return rollup.as_period_means(hour).drop("connection_types")


def scheduled_year(spark, sf_dir):
    """What the yearly run at the as-of moment builds, from a stored month table."""
    folder = session.fresh_folder(spark, "months")
    sinks.write_summaries(rollup.monthly(rollup.daily(tables.long_series(spark, sf_dir))), "monthly", folder)
    year = jobs.run("yearly", sinks.read_summaries(spark, folder), YEAR_AS_OF)
    return year.select("host_id", "period", "months_aggregated", "avg_download", "avg_upload", "avg_ping")


def backfill_hours(spark, sf_dir):
    """Hours built again where the table lacks one host's noon."""
    m = tables.measurements(spark, sf_dir)
    lacking = (F.col("host_id") == "host-1") & (F.hour("period") == 12)
    present = sinks.written(quality.period_keys(m, "hourly").where(~lacking), "present")
    built = jobs.backfill("hourly", m, AS_OF, existing=present)
    return rollup.as_period_means(built).drop("connection_types")


def backfill_days(spark, sf_dir):
    """Days built again where the table lacks the Mondays of all hosts together."""
    m = tables.measurements(spark, sf_dir)
    lacking = (F.col("host_id") == "all") & (F.dayofweek("period") == 2)
    present = sinks.written(quality.period_keys(m, "daily").where(~lacking), "present")
    built = jobs.backfill("daily", m, AS_OF, existing=present)
    return rollup.as_period_means(built).drop("connection_types")


def backfill_years(spark, sf_dir):
    """The closed years, built from months."""
    months = rollup.monthly(rollup.daily(tables.long_series(spark, sf_dir)))
    built = jobs.backfill("yearly", months, YEAR_AS_OF)
    return built.select("host_id", "period", "months_aggregated", "avg_download", "avg_upload", "avg_ping")


def retained_hours(spark, sf_dir):
    """An hourly table after its retention: the next version, written and read back."""
    keys = sinks.written(quality.period_keys(tables.measurements(spark, sf_dir), "hourly"), "hours")
    left = retention.retained(keys, retention.expired(keys, "hourly", RETENTION_AS_OF))
    folder = session.fresh_folder(spark, "retained")
    sinks.write_version(left.withColumn("day", F.date_format("period", "yyyyMMdd")), folder, ["day"])
    return sinks.read_summaries(spark, folder).select("host_id", "period")


def last_hours_deleted(spark, sf_dir):
    """Hourly and daily tables after the deletion of their last 48 hours and 3 days."""
    m = tables.measurements(spark, sf_dir)
    out = None
    for level, n in (("hourly", 48), ("daily", 3)):
        keys = sinks.written(quality.period_keys(m, level), level)
        left = retention.retained(keys, retention.last_n(keys, level, AS_OF, n))
        part = left.select(F.lit(level).alias("level"), "host_id", F.col("period").cast("timestamp_ntz").alias("period"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        own_documents_valid, summary_tables, scheduled_hour, scheduled_year, backfill_hours, backfill_days,
        backfill_years, retained_hours, last_hours_deleted,
    )
}

_HOURS = sql.with_(sql.M, _HOUR_MEANS)
_YEARS = sql.with_(sql.O, sql.DAY_MEANS, sql.coarser("d", "monthly", "mo"), sql.coarser("mo", "yearly", "y"))
_KEYS = f"""keys AS (SELECT DISTINCT h.host AS host_id, date_trunc('hour', bucket_start) AS hour, CAST(bucket_start AS DATE) AS day
  FROM m, LATERAL (SELECT unnest([m.host_id, 'all']) AS host) h)"""
ORACLES = {
    "own_documents_valid": _all_levels_sql("level, count(*) AS documents, 0::BIGINT AS invalid") + " GROUP BY level",
    "summary_tables": _all_levels_sql(f"level, host_id, period, n, {_MEANS}"),
    "scheduled_hour": _HOURS + f"SELECT host_id, period, {_MEANS} FROM d WHERE period = TIMESTAMP '2024-01-31 05:00:00'",
    "scheduled_year": sql.dated(_YEARS + f"SELECT host_id, period, n AS months_aggregated, {_MEANS} FROM y WHERE period = DATE '2001-01-01'", "period"),
    "backfill_hours": _HOURS
    + f"""SELECT host_id, period, {_MEANS} FROM d WHERE period < TIMESTAMP '2024-01-31 06:00:00' AND hour(period) = 12
  AND period IN (SELECT date_trunc('hour', bucket_start) FROM m WHERE host_id = 'host-1')""",
    "backfill_days": sql.dated(
        sql.with_(sql.M, sql.DAY_MEANS)
        + f"SELECT host_id, period, {_MEANS} FROM d WHERE dayofweek(period) = 1 AND period < DATE '2024-01-31'",
        "period",
    ),
    "backfill_years": sql.dated(_YEARS + f"SELECT host_id, period, n AS months_aggregated, {_MEANS} FROM y WHERE period < DATE '2001-01-01'", "period"),
    "retained_hours": sql.with_(sql.M, _KEYS)
    + "SELECT DISTINCT host_id, hour AS period FROM keys WHERE hour >= TIMESTAMP '2024-04-15 00:00:00' - INTERVAL 90 DAY",
    "last_hours_deleted": sql.with_(sql.M, _KEYS)
    + """SELECT DISTINCT 'hourly' AS level, host_id, hour AS period FROM keys WHERE hour < TIMESTAMP '2024-01-29 06:00:00'
UNION ALL SELECT DISTINCT 'daily', host_id, CAST(day AS TIMESTAMP) FROM keys WHERE day < DATE '2024-01-29'""",
}

"""Coverage, duplicate, validation, lineage, backfill and retention queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netpulse.catalogue import chart_sql, sql
from netpulse.catalogue.views import X_MINUTE
from netpulse.functions import timeparts
from netpulse.operators import downsample, quality, retention, rollup, validate, views
from netpulse.plans import jobs
from netpulse.sinks.tables import written
from netpulse.sources import tables

AS_OF = datetime(2024, 1, 31, 6, 0)
LONG_AS_OF = datetime(2001, 8, 2)
FAN = "(SELECT unnest([{t}.host_id, 'all']) AS host) h"


def hourly_coverage(spark, sf_dir):
    return quality.coverage(tables.measurements(spark, sf_dir))


COVERAGE_SQL = (
    sql.with_(sql.M)
    + f"""SELECT h.host AS host_id, date_trunc('hour', bucket_start) AS hour,
  count(DISTINCT bucket_start) AS distinct_minutes, count(*) AS records,
  CAST({sql.half_up('1000 * count(DISTINCT bucket_start)', '4')} AS BIGINT) / 10::DOUBLE AS coverage_percent
FROM m, LATERAL {FAN.format(t='m')} GROUP BY 1, 2"""
)


def daily_coverage(spark, sf_dir):
    return quality.coverage_by_date(quality.coverage(tables.measurements(spark, sf_dir)))


DAILY_COVERAGE_SQL = sql.dated(
    sql.with_(sql.M)
    + f"""SELECT h.host AS host_id, CAST(bucket_start AS DATE) AS date,
  count(DISTINCT date_trunc('hour', bucket_start)) AS total_hours_found, count(*) AS total_records
FROM m, LATERAL {FAN.format(t='m')} GROUP BY 1, 2""",
    "date",
)


def missing_periods(spark, sf_dir):
    m = tables.measurements(spark, sf_dir)
    present = written(quality.period_keys(m, "hourly"), "hours")
    hours = quality.missing_periods(present, "hourly", "daily")
    days = quality.missing_periods(quality.coarser_keys(present, "daily"), "daily", "weekly")
    return hours.select("host_id", F.lit("hourly").alias("level"), "within", "period").unionByName(
        days.select("host_id", F.lit("daily").alias("level"), "within", F.col("period").cast("timestamp_ntz").alias("period"))
    )


MISSING_SQL = sql.dated(
    sql.with_(sql.M)
    + f""", k AS (SELECT DISTINCT h.host AS host_id, date_trunc('hour', bucket_start) AS hr FROM m, LATERAL {FAN.format(t='m')}),
b AS (SELECT host_id, min(hr) AS lo, max(hr) AS hi FROM k GROUP BY host_id),
sh AS (SELECT host_id, unnest(generate_series(date_trunc('day', lo), date_trunc('day', hi) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS p FROM b),
sd AS (SELECT host_id, unnest(generate_series(CAST(date_trunc('week', lo) AS TIMESTAMP), CAST(date_trunc('week', hi) AS TIMESTAMP) + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS p FROM b)
SELECT host_id, 'hourly' AS level, CAST(p AS DATE) AS within, CAST(p AS TIMESTAMP) AS period FROM sh ANTI JOIN k ON sh.host_id = k.host_id AND sh.p = k.hr
UNION ALL
SELECT host_id, 'daily', CAST(date_trunc('week', p) AS DATE), CAST(p AS TIMESTAMP) FROM sd ANTI JOIN k
  ON sd.host_id = k.host_id AND sd.p = date_trunc('day', k.hr)""",
    "within",
)


def missing_to_date(spark, sf_dir):
    """Missing hours and days up to a morning in February; one host is silent from the 20th of January on."""
    as_of, stop = datetime(2024, 2, 3, 6, 20), F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz")
    m = tables.measurements(spark, sf_dir).where((F.col("host_id") != "host-3") | (F.col("bucket_start") < stop))
    present = written(quality.period_keys(m, "hourly"), "hours")
    hours = quality.missing_periods(present, "hourly", "daily", as_of)
    days = quality.missing_periods(quality.coarser_keys(present, "daily"), "daily", "weekly", as_of)
    return hours.select("host_id", F.lit("hourly").alias("level"), "within", "period").unionByName(
        days.select("host_id", F.lit("daily").alias("level"), "within", F.col("period").cast("timestamp_ntz").alias("period"))
    )


MISSING_TO_DATE_SQL = sql.dated(
    sql.with_(sql.M)
    + f""", k AS (SELECT DISTINCT h.host AS host_id, date_trunc('hour', bucket_start) AS hr FROM m, LATERAL {FAN.format(t='m')}
  WHERE (m.host_id <> 'host-3' OR bucket_start < TIMESTAMP '2024-01-20') AND bucket_start < TIMESTAMP '2024-02-03 06:00:00'),
bh AS (SELECT host_id, min(hr) AS lo FROM k GROUP BY host_id),
bd AS (SELECT host_id, min(hr) AS lo FROM k WHERE hr < TIMESTAMP '2024-02-03' GROUP BY host_id),
sh AS (SELECT host_id, unnest(generate_series(date_trunc('day', lo), TIMESTAMP '2024-02-03 05:00:00', INTERVAL 1 HOUR)) AS p FROM bh),
sd AS (SELECT host_id, unnest(generate_series(CAST(date_trunc('week', lo) AS TIMESTAMP), TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS p FROM bd)
SELECT host_id, 'hourly' AS level, CAST(p AS DATE) AS within, CAST(p AS TIMESTAMP) AS period FROM sh ANTI JOIN k ON sh.host_id = k.host_id AND sh.p = k.hr
UNION ALL
SELECT host_id, 'daily', CAST(date_trunc('week', p) AS DATE), CAST(p AS TIMESTAMP) FROM sd ANTI JOIN k
  ON sd.host_id = k.host_id AND sd.p = date_trunc('day', k.hr)""",
    "within",
)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurement files and, as daily files, every order day: both hold copies."""
    o = tables.long_series(spark, sf_dir)
    daily = o.select(
        F.lit("daily").alias("level"),
        "host_id",
        F.date_format("local_ts", "yyyy-MM-dd").alias("period_key"),
        F.concat(F.lit("d"), F.lpad(F.col("seq").cast("string"), 12, "0")).alias("path"),
        (F.col("local_ts") + F.make_dt_interval(secs=(F.col("seq") % 1000).cast("decimal(18,6)"))).alias("modified"),
    )
    return quality.inventory_of(tables.measurements(spark, sf_dir)).unionByName(daily)


INV = (
    sql.M
    + """,
i AS (SELECT 'minutes' AS level, host_id, strftime(bucket_start, '%Y%m%d%H%M') AS period_key,
    lpad(CAST(seq AS VARCHAR), 12, '0') AS path, ts AS modified FROM m
  UNION ALL SELECT 'daily', 'host-' || (o_custkey % 5), strftime(o_orderdate, '%Y-%m-%d'),
    'd' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), o_orderdate + to_seconds(o_orderkey % 1000) FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY level, host_id, period_key ORDER BY modified, path) AS r,
    count(*) OVER (PARTITION BY level, host_id, period_key) AS files FROM i)"""
)


def duplicate_buckets(spark, sf_dir):
    return quality.duplicate_groups(_files(spark, sf_dir)).select(
        "level", "host_id", "period_key", "files", F.col("oldest.path").alias("oldest_path")
    )


def duplicate_totals(spark, sf_dir):
    return quality.duplicate_totals(_files(spark, sf_dir))


def duplicate_removal_plan(spark, sf_dir):
    return quality.files_to_delete(_files(spark, sf_dir)).select("level", "host_id", "period_key", "path")


def dedup_keep_oldest(spark, sf_dir):
    m = tables.measurements(spark, sf_dir).select(
        "seq", "ts", "host_id", "bucket_start", "server_label", "public_ip", "connection_type"
    )
    return quality.keep_oldest(m, ["host_id", "bucket_start"], ["ts", "seq"])


def duplicate_report(spark, sf_dir):
    return quality.duplicate_report(quality.inventory_of(tables.measurements(spark, sf_dir)))


REPORT_SQL = (
    sql.with_(INV)
    + """, g AS (SELECT * FROM r WHERE level = 'minutes' AND files > 1),
t AS (SELECT level, host_id, period_key FROM g WHERE r = 1 ORDER BY period_key DESC, host_id LIMIT 20)
SELECT level, host_id, period_key, path, modified, files, (SELECT count(*) FROM g WHERE r = 1) AS buckets_in_all,
  greatest((SELECT count(*) FROM g WHERE r = 1) - 20, 0) AS more_buckets
FROM g SEMI JOIN t USING (level, host_id, period_key)"""
)


def duplicates_in_newest(spark, sf_dir):
    newest = quality.newest_files(quality.inventory_of(tables.measurements(spark, sf_dir)), 1000)
    return quality.duplicate_groups(newest).select("host_id", "period_key", "files")


NEWEST_SQL = (
    sql.with_(INV)
    + """SELECT host_id, period_key, count(*) AS files FROM (
  SELECT * FROM i WHERE level = 'minutes' ORDER BY modified DESC, path DESC LIMIT 1000)
GROUP BY host_id, period_key HAVING count(*) > 1"""
)


def insert_if_absent(spark, sf_dir):
    """Odd events arrive where even ones have landed."""
    m = tables.measurements(spark, sf_dir).select("seq", "ts", "host_id", "bucket_start", "download_c")
    odd = F.col("seq") % 2 == 1
    return quality.insert_if_absent(
        m.where(odd), m.where(~odd), ["host_id", "bucket_start"], ["ts", "seq"]
    ).select("seq", "ts", "host_id", "bucket_start")


INSERT_SQL = (
    sql.with_(sql.M)
    + """SELECT seq, ts, host_id, bucket_start FROM (
  SELECT *, row_number() OVER (PARTITION BY host_id, bucket_start ORDER BY ts, seq) AS r FROM m WHERE seq % 2 = 1) a
ANTI JOIN (SELECT * FROM m WHERE seq % 2 = 0) b USING (host_id, bucket_start) WHERE r = 1"""
)


def data_availability(spark, sf_dir):
    m = tables.measurements(spark, sf_dir)
    hours = written(quality.period_keys(m, "hourly"), "hours")
    keys = {level: quality.coarser_keys(hours, level) for level in ("daily", "weekly", "monthly", "yearly")}
    return jobs.availability(m, {"hourly": hours, **keys})


AVAILABILITY_SQL = sql.with_(sql.M, f"f AS (SELECT h.host AS host_id, bucket_start AS b FROM m, LATERAL {FAN.format(t='m')})") + " UNION ALL ".join(
    [
        "SELECT 'minutes' AS level, count(*) AS periods, min(strftime(bucket_start, '%Y-%m-%d %H:%M')) AS first_period, "
        "max(strftime(bucket_start, '%Y-%m-%d %H:%M')) AS last_period FROM m"
    ]
    + [
        f"SELECT '{level}', count(*), min({label}), max({label}) FROM (SELECT DISTINCT host_id, date_trunc('{unit}', b) AS p FROM f)"
        for level, unit, label in (
            ("hourly", "hour", "strftime(p, '%Y-%m-%d %H:00')"),
            ("daily", "day", "strftime(p, '%Y-%m-%d')"),
            ("weekly", "week", "strftime(p, '%Y-%m-%d') || ' to ' || strftime(p + INTERVAL 6 DAY, '%Y-%m-%d')"),
            ("monthly", "month", "strftime(p, '%Y-%m')"),
            ("yearly", "year", "strftime(p, '%Y')"),
        )
    ]
)


def list_hosts(spark, sf_dir):
    return quality.list_hosts(tables.measurements(spark, sf_dir))


# --- validation -----------------------------------------------------------
# Documents are built from the given tables; a number derived from the keys puts
# one of several faults into some of them.


def _hour_docs(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """One document per host and period with its record count and mean download."""
    keyed = tables.measurements(spark, sf_dir).groupBy(
        "host_id", timeparts.period_of(F.col("bucket_start"), level).alias("period")
    )
    rows = keyed.agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("k"))
    name, pattern = ("hour_ist", "yyyy-MM-dd HH:00") if level == "hourly" else ("date_ist", "yyyy-MM-dd")
    fault = "k % 13"
    label = f"date_format(period, '{pattern}')"
    stamp = f"if({fault} = 8, 'yesterday', {label})"
    return rows.selectExpr(
        f"concat(host_id, '/', {label}) as key",
        f"""case when {fault} = 1 then concat('{{"{name}": "', {label}, '", "records": ') else
        concat('{{"{name}": "', {stamp}, '"',
          case {fault} when 2 then '' when 3 then ', "records": "many"' when 4 then ', "records": -1'
            when 5 then ', "records": 0' else concat(', "records": ', n) end,
          case {fault} when 11 then ', "completion_rate": -1.5' when 12 then ', "completion_rate": 101.5' else '' end,
          case {fault} when 6 then '' when 7 then ', "overall": "none"' else concat(', "overall": {{"download_mbps": {{"avg": ',
            if({fault} = 9, '2001.5', '120.25'), ', "median": 100.0, "max": 180.5, "min": 50.25}}',
            if({fault} = 10, '', ', "upload_mbps": {{"avg": 60.0, "median": 50.5, "max": 90.0}}'),
            ', "ping_ms": {{"avg": 10.0, "median": 9.0, "max": 20.0, "min": 5.0}}}}') end, '}}') end as doc""",
    )


def _validate(level: str):
    def run(spark, sf_dir):
        docs = _hour_docs(spark, sf_dir, level) if level in ("hourly", "daily") else _coarse_docs(spark, sf_dir, level)
        return _shown(validate.validate(docs, level, 2024))

    return run


def _shown(results: DataFrame) -> DataFrame:
    return results.select(
        "level",
        "key",
        "valid",
        F.array_join("errors", "; ").alias("errors"),
        F.array_join("warnings", "; ").alias("warnings"),
    )


def _hour_rules_sql(level: str) -> str:
    """CTE: expected messages, from the fault number."""
    name, label = ("hour_ist", "strftime(period, '%Y-%m-%d %H:00')") if level == "hourly" else ("date_ist", "strftime(period, '%Y-%m-%d')")
    cap = 4 if level == "hourly" else 96
    over = "' exceeds expected 4 per hour'" if level == "hourly" else "' exceeds expected 96 per day (multi-host?)'"
    no_stat = "CASE WHEN f NOT IN (6, 7, 10) THEN 'Missing stat min in overall.upload_mbps' END"
    daily = level == "daily"
    errors = [
        "CASE f WHEN 2 THEN 'Missing required field: records' WHEN 3 THEN 'Field records has wrong type: expected int' END",
        "CASE f WHEN 6 THEN 'Missing required field: overall' WHEN 7 THEN 'Field overall has wrong type: expected object' END",
        "CASE WHEN f = 8 THEN 'Invalid date format: yesterday, expected YYYY-MM-DD' END" if daily else "NULL",
        "CASE WHEN f = 10 THEN 'Missing metric in overall: upload_mbps' END",
        "NULL" if daily else no_stat,
        "CASE WHEN f = 4 THEN 'records cannot be negative' END",
        "CASE WHEN f = 11 THEN 'completion_rate=-1.5 cannot be negative' END" if daily else "NULL",
    ]
    warnings = [
        no_stat if daily else "NULL",
        "CASE WHEN f = 5 THEN 'records is 0 - empty aggregation' END",
        f"CASE WHEN f NOT IN (2, 3, 4, 5) AND n > {cap} THEN 'records=' || n || {over} END",
        "CASE WHEN f = 12 THEN 'completion_rate=101.5% exceeds 100% (multi-host or frequent tests)' END" if daily else "NULL",
        "NULL" if daily else "CASE WHEN f = 9 THEN 'download_mbps.avg=2001.5 is above maximum 2000' END",
    ]
    return f"""SELECT '{level}' AS level, host_id || '/' || {label} AS key, errors = '' AS valid, errors, warnings FROM (
  SELECT *, CASE WHEN f = 1 THEN 'Invalid JSON' ELSE concat_ws('; ', {', '.join(errors)}) END AS errors,
    CASE WHEN f = 1 THEN '' ELSE concat_ws('; ', {', '.join(warnings)}) END AS warnings
  FROM (SELECT host_id, {sql.PERIOD[level]} AS period, count(*) AS n, max(seq) % 13 AS f FROM m GROUP BY 1, 2))"""


def _coarse_docs(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    keyed = tables.long_series(spark, sf_dir).groupBy(
        "host_id", timeparts.period_of(F.col("bucket_start"), level).alias("period")
    )
    rows = keyed.agg(F.max("seq").alias("k"))
    fault = "k % 11"
    count = {"weekly": "days", "monthly": "days", "yearly": "months_aggregated"}[level]
    head = {
        "weekly": f"""concat('"week_start": "', if({fault} = 7, '2024-13-45', date_format(period, 'yyyy-MM-dd')),
            '", "week_end": "', date_format(date_add(period, 6), 'yyyy-MM-dd'), '"')""",
        "monthly": f"""concat('"month": "', if({fault} = 7, '2024-1', date_format(period, 'yyyyMM')), '"')""",
        "yearly": f"""concat('"year": ', if({fault} = 7, 2019, 2020 + year(period) % 5))""",
    }[level]
    return rows.selectExpr(
        "concat(host_id, '/', date_format(period, 'yyyy-MM-dd')) as key",
        f"""if({fault} = 1, '{{"broken', concat('{{', {head},
          case {fault} when 2 then '' when 3 then ', "{count}": "x"' when 4 then ', "{count}": -2'
            when 5 then ', "{count}": 0' when 6 then ', "{count}": 40' else ', "{count}": 5' end,
          case {fault} when 8 then '' when 9 then ', "avg_download": 2500.25' else ', "avg_download": 150.5' end,
          ', "avg_upload": ', if({fault} = 10, '-1', '75'), ', "avg_ping": ', if({fault} = 9, '1000.5', '12.5'), '}}')) as doc""",
    )


def _coarse_rules_sql(level: str) -> str:
    count, most = {"weekly": ("days", 7), "monthly": ("days", 31), "yearly": ("months_aggregated", 12)}[level]
    tail = {"weekly": " for a week", "monthly": " for a month", "yearly": ""}[level]
    bad_key = {
        "weekly": "Invalid date format: 2024-13-45",
        "monthly": "Invalid month format: 2024-1, expected YYYYMM",
        "yearly": "year=2019 seems invalid",
    }[level]
    errors = [
        f"CASE f WHEN 2 THEN 'Missing required field: {count}' WHEN 3 THEN 'Field {count} has wrong type: expected int' END",
        "CASE f WHEN 8 THEN 'Missing required field: avg_download' END",
        f"CASE f WHEN 7 THEN '{bad_key}' END",
        f"CASE f WHEN 4 THEN '{count} cannot be negative' END",
        f"CASE WHEN f = 6 THEN '{count}=40 exceeds {most}{tail}' END",
    ]
    warnings = [
        f"CASE f WHEN 5 THEN '{count} is 0 - empty aggregation' END",
        "CASE f WHEN 9 THEN 'avg_download=2500.25 is above maximum 2000' END",
        "CASE f WHEN 10 THEN 'avg_upload=-1 is below minimum 0' END",
        "CASE f WHEN 9 THEN 'avg_ping=1000.5 is above maximum 1000' END" if level == "weekly" else "NULL",
    ]
    unit = {"weekly": "week", "monthly": "month", "yearly": "year"}[level]
    return f"""SELECT '{level}' AS level, host_id || '/' || strftime(period, '%Y-%m-%d') AS key, errors = '' AS valid, errors, warnings FROM (
  SELECT *, CASE WHEN f = 1 THEN 'Invalid JSON' ELSE concat_ws('; ', {', '.join(errors)}) END AS errors,
    CASE WHEN f = 1 THEN '' ELSE concat_ws('; ', {', '.join(warnings)}) END AS warnings
  FROM (SELECT 'host-' || (o_custkey % 5) AS host_id, date_trunc('{unit}', o_orderdate) AS period, max(o_orderkey) % 11 AS f
    FROM orders GROUP BY 1, 2))"""


def _rules_sql(level: str) -> str:
    return _hour_rules_sql(level) if level in ("hourly", "daily") else _coarse_rules_sql(level)


def _all_documents(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = {level: _hour_docs(spark, sf_dir, level) for level in ("hourly", "daily")}
    docs |= {level: _coarse_docs(spark, sf_dir, level) for level in ("weekly", "monthly", "yearly")}
    return docs


def _all_results(docs: dict[str, DataFrame]) -> DataFrame:
    out = None
    for level, df in docs.items():
        part = validate.validate(df, level, 2024)
        out = part if out is None else out.unionByName(part)
    return out


ALL_RULES = " UNION ALL ".join(
    f"SELECT * FROM ({_rules_sql(level)})" for level in ("hourly", "daily", "weekly", "monthly", "yearly")
)
COUNTS_SQL = """count(*) AS total, count(*) FILTER (WHERE valid) AS valid,
  count(*) FILTER (WHERE NOT valid) AS invalid, count(*) FILTER (WHERE valid AND warnings <> '') AS warnings"""


def validation_report(spark, sf_dir):
    return validate.report(_all_results(_all_documents(spark, sf_dir)))


def validation_sample(spark, sf_dir):
    # Written first: projections moved below the limit would turn the top-N into a full sort.
    docs = written(validate.sample(_hour_docs(spark, sf_dir, "hourly"), 200, "7"), "sample")
    return _shown(validate.validate(docs, "hourly", 2024))


SAMPLE_SQL = sql.with_(sql.M) + f"SELECT * FROM ({_rules_sql('hourly')}) ORDER BY md5('7' || key), key LIMIT 200"


def verify_manifest(spark, sf_dir):
    """The manifest lists the weeks and months since 1999 a backfill produced."""
    listed = None
    docs = None
    for level in ("weekly", "monthly"):
        typed = _coarse_docs(spark, sf_dir, level).withColumn("type", F.lit(level))
        made = typed.where(F.substring_index("key", "/", -1) >= "1999-01-01").select("type", "key")
        listed = made if listed is None else listed.unionByName(made)
        docs = typed if docs is None else docs.unionByName(typed)
    chosen = validate.restrict_to_manifest(docs, listed)
    parts = {level: chosen.where(F.col("type") == level) for level in ("weekly", "monthly")}
    return validate.report(_all_results(parts))


VERIFY_SQL = (
    f"SELECT level, {COUNTS_SQL} FROM ({_coarse_rules_sql('weekly')} UNION ALL {_coarse_rules_sql('monthly')}) "
    "WHERE split_part(key, '/', 2) >= '1999-01-01' GROUP BY level"
)


# --- lineage, backfill, retention ------------------------------------------


def _lossy(spark: SparkSession, sf_dir: str):
    """Days, months without some Mays, years without 1997."""
    o = tables.long_series(spark, sf_dir)
    days = written(quality.period_keys(o, "daily"), "days")
    months, years = (quality.coarser_keys(days, level) for level in ("monthly", "yearly"))
    months = months.where(~((F.month("period") == 5) & (F.year("period") % 2 == 1)))
    return days, months, years.where(F.year("period") != 1997)


def lineage_gaps(spark, sf_dir):
    return quality.lineage_gaps(*_lossy(spark, sf_dir), LONG_AS_OF)


LINEAGE_SQL = sql.dated(
    """WITH mo AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS p FROM orders),
kept AS (SELECT p FROM mo WHERE NOT (month(p) = 5 AND year(p) % 2 = 1))
SELECT 'missing monthly' AS issue, p AS period FROM mo WHERE p NOT IN (SELECT p FROM kept) AND p <> DATE '2001-08-01'
UNION ALL SELECT DISTINCT 'missing yearly', CAST(date_trunc('year', p) AS DATE) FROM kept
WHERE year(p) = 1997 AND year(p) <> 2001""",
    "period",
)


def lineage_counts(spark, sf_dir):
    days = written(quality.period_keys(tables.long_series(spark, sf_dir), "daily"), "days")
    coarser = {level: quality.coarser_keys(days, level) for level in ("monthly", "yearly")}
    return quality.lineage_counts({"daily": days} | coarser)


LINEAGE_COUNTS_SQL = """SELECT 'daily' AS level, count(DISTINCT o_orderdate) AS periods FROM orders
UNION ALL SELECT 'monthly', count(DISTINCT date_trunc('month', o_orderdate)) FROM orders
UNION ALL SELECT 'yearly', count(DISTINCT year(o_orderdate)) FROM orders"""


def _backfilled(df: DataFrame, level: str) -> DataFrame:
    return df.select(
        "host_id", "period", rollup.COUNT_NAME[level], "avg_download", "avg_upload", "avg_ping",
        jobs.path_of(level).alias("key"),
    )


def backfill_missing(spark, sf_dir):
    """Months built again where the month table has none; the open month is left out."""
    o = tables.long_series(spark, sf_dir)
    _, months, _ = _lossy(spark, sf_dir)
    days = written(rollup.daily(o).select("host_id", "period", "overall", "connection_types"), "daily")
    return _backfilled(jobs.backfill("monthly", days, LONG_AS_OF, existing=months), "monthly")


def _key_sql(level: str) -> str:
    tail = {
        "monthly": "'month=' || strftime(period, '%Y%m')",
        "weekly": "'week=' || isoyear(period) || 'W' || lpad(CAST(weekofyear(period) AS VARCHAR), 2, '0')",
    }[level]
    host = "CASE WHEN host_id = 'all' THEN '' ELSE 'host=' || host_id || '/' END"
    return f"'aggregated/' || {host} || 'year=' || strftime(period, '%Y') || '/' || {tail} || '/summary.json'"


_MEANS = ", ".join(f"{sql.hundredth(c)} AS avg_{m}" for c, m in (("dl_c", "download"), ("ul_c", "upload"), ("ping_c", "ping")))
BACKFILL_SQL = sql.dated(
    sql.with_(sql.O, sql.DAY_MEANS, sql.coarser("d", "monthly", "mo"))
    + f"""SELECT host_id, period, n AS days, {_MEANS}, {_key_sql('monthly')} AS key FROM mo
WHERE month(period) = 5 AND year(period) % 2 = 1 AND period <> DATE '2001-08-01'""",
    "period",
)


def backfill_last_n(spark, sf_dir):
    o = tables.long_series(spark, sf_dir)
    return _backfilled(jobs.backfill("weekly", rollup.daily(o), LONG_AS_OF, last=40), "weekly")


BACKFILL_LAST_SQL = sql.dated(
    sql.with_(sql.O, sql.DAY_MEANS, sql.coarser("d", "weekly", "w"))
    + f"""SELECT host_id, period, n AS days, {_MEANS}, {_key_sql('weekly')} AS key FROM w
WHERE period >= DATE '2001-07-30' - INTERVAL 280 DAY AND period < DATE '2001-07-30'""",
    "period",
)


def backfill_manifest(spark, sf_dir):
    o = tables.long_series(spark, sf_dir)
    built = jobs.backfill("monthly", rollup.daily(o), LONG_AS_OF, force=True)
    return jobs.manifest(built, "monthly", LONG_AS_OF)


MANIFEST_SQL = (
    sql.with_(sql.O, sql.DAY_MEANS, sql.coarser("d", "monthly", "mo"))
    + f"""SELECT TIMESTAMP '2001-08-02 00:00:00' AS timestamp, 'monthly' AS type, 'netpulse-monthly' AS bucket,
  {_key_sql('monthly')} AS key FROM mo"""
)


def scheduled_runs(spark, sf_dir):
    """What a scheduled run at the as-of moment builds for days, weeks and months."""
    m = tables.measurements(spark, sf_dir)
    days = written(rollup.daily(m).select("host_id", "period", "overall", "connection_types"), "daily")
    week = jobs.run("weekly", days, AS_OF)
    month = jobs.run("monthly", days, AS_OF)
    day = rollup.as_period_means(jobs.run("daily", m, AS_OF)).withColumn("days", F.lit(1).cast("bigint"))
    columns = ["host_id", "period", "days", "avg_download", "avg_upload", "avg_ping"]
    out = None
    for level, df in (("daily", day), ("weekly", week), ("monthly", month)):
        part = df.select(F.lit(level).alias("level"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


SCHEDULED_SQL = sql.dated(
    sql.with_(
        sql.M,
        sql.DAY_MEANS,
        "dm AS (SELECT * FROM d WHERE period >= DATE '2024-01-01' AND period < DATE '2024-01-31')",
        "dw AS (SELECT * FROM d WHERE period >= DATE '2024-01-22' AND period < DATE '2024-01-29')",
        sql.coarser("dw", "weekly", "w"),
        sql.coarser("dm", "monthly", "mo"),
    )
    + f"""SELECT 'daily' AS level, host_id, period, 1 AS days, {_MEANS} FROM d WHERE period = DATE '2024-01-30'
UNION ALL SELECT 'weekly', host_id, period, n, {_MEANS} FROM w UNION ALL SELECT 'monthly', host_id, period, n, {_MEANS} FROM mo""",
    "period",
)

PLAN_LEVELS = ("weekly", "monthly", "yearly")


def _plan(spark, sf_dir, rule) -> DataFrame:
    o = tables.long_series(spark, sf_dir)
    days = written(quality.period_keys(o, "daily"), "days")
    out = None
    for level in PLAN_LEVELS:
        part = rule(quality.coarser_keys(days, level), level).select(
            F.lit(level).alias("level"), "host_id", "period", jobs.path_of(level).alias("key")
        )
        out = part if out is None else out.unionByName(part)
    return out


def retention_plan(spark, sf_dir):
    return _plan(spark, sf_dir, lambda keys, level: retention.expired(keys, level, LONG_AS_OF))


def delete_last_n_plan(spark, sf_dir):
    return _plan(spark, sf_dir, lambda keys, level: retention.last_n(keys, level, LONG_AS_OF, 4))


def _plan_sql(conditions: dict[str, str]) -> str:
    tails = {
        "weekly": "'/week=' || isoyear(p) || 'W' || lpad(CAST(weekofyear(p) AS VARCHAR), 2, '0')",
        "monthly": "'/month=' || strftime(p, '%Y%m')",
        "yearly": "''",
    }
    parts = [
        f"""SELECT '{level}' AS level, host AS host_id, p AS period, 'aggregated/' || CASE WHEN host = 'all' THEN '' ELSE 'host=' || host || '/' END
  || 'year=' || strftime(p, '%Y') || {tails[level]} || '/summary.json' AS key FROM (
    SELECT DISTINCT h.host, CAST(date_trunc('{level.removesuffix("ly")}', bucket_start) AS DATE) AS p
    FROM m, LATERAL {FAN.format(t='m')}) WHERE {condition}"""
        for level, condition in conditions.items()
    ]
    return sql.dated(sql.with_(sql.O) + " UNION ALL ".join(parts), "period")


# --- chart series -----------------------------------------------------------


def downsample_minute(spark, sf_dir):
    """Chart points of every host from single measurements."""
    view = views.minute_view(tables.measurements(spark, sf_dir))
    return downsample.chart_series(view, ["host_id"], ["seq"], 200)


def downsample_hourly(spark, sf_dir):
    """Chart points of every host and of ``all`` from hourly means."""
    hours = rollup.hourly(tables.measurements(spark, sf_dir)).select(
        "host_id",
        F.col("period").alias("date_ist"),
        F.col("overall.download_mbps.avg").alias("download_avg"),
        F.col("overall.upload_mbps.avg").alias("upload_avg"),
        F.col("overall.ping_ms.avg").alias("ping_avg"),
        F.array_join("connection_types", ", ").alias("connection_type"),
    )
    return downsample.chart_series(hours, ["host_id"], [], 300)


QUERIES = {
    "hourly_coverage": hourly_coverage,
    "daily_coverage": daily_coverage,
    "missing_periods": missing_periods,
    "missing_to_date": missing_to_date,
    "duplicate_buckets": duplicate_buckets,
    "duplicate_totals": duplicate_totals,
    "duplicate_removal_plan": duplicate_removal_plan,
    "dedup_keep_oldest": dedup_keep_oldest,
    "duplicate_report": duplicate_report,
    "duplicates_in_newest": duplicates_in_newest,
    "insert_if_absent": insert_if_absent,
    "data_availability": data_availability,
    "list_hosts": list_hosts,
    **{f"validate_{level}": _validate(level) for level in ("hourly", "daily", "weekly", "monthly", "yearly")},
    "validation_report": validation_report,
    "validation_sample": validation_sample,
    "verify_manifest": verify_manifest,
    "lineage_gaps": lineage_gaps,
    "lineage_counts": lineage_counts,
    "backfill_missing": backfill_missing,
    "backfill_last_n": backfill_last_n,
    "backfill_manifest": backfill_manifest,
    "scheduled_runs": scheduled_runs,
    "retention_plan": retention_plan,
    "delete_last_n_plan": delete_last_n_plan,
    "downsample_minute": downsample_minute,
    "downsample_hourly": downsample_hourly,
}
_INV = sql.with_(INV)
ORACLES = {
    "downsample_minute": chart_sql.chart(sql.with_(sql.M, X_MINUTE).rstrip(), chart_sql.MINUTE_POINTS, 200),
    "downsample_hourly": chart_sql.chart(sql.with_(sql.M, sql.summary("hourly")).rstrip(), chart_sql.HOUR_POINTS, 300),
    "hourly_coverage": COVERAGE_SQL,
    "daily_coverage": DAILY_COVERAGE_SQL,
    "missing_periods": MISSING_SQL,
    "missing_to_date": MISSING_TO_DATE_SQL,
    "duplicate_buckets": _INV + "SELECT level, host_id, period_key, files, path AS oldest_path FROM r WHERE files > 1 AND r = 1",
    "duplicate_totals": _INV + "SELECT level, count(*) FILTER (WHERE r = 1) AS buckets, count(*) FILTER (WHERE r > 1) AS duplicates FROM r WHERE files > 1 GROUP BY level",
    "duplicate_removal_plan": _INV + "SELECT level, host_id, period_key, path FROM r WHERE r > 1",
    "dedup_keep_oldest": sql.with_(sql.M)
    + """SELECT seq, ts, host_id, bucket_start, server_label, public_ip, connection_type FROM m
QUALIFY row_number() OVER (PARTITION BY host_id, bucket_start ORDER BY ts, seq) = 1""",
    "duplicate_report": REPORT_SQL,
    "duplicates_in_newest": NEWEST_SQL,
    "insert_if_absent": INSERT_SQL,
    "data_availability": AVAILABILITY_SQL,
    "list_hosts": sql.with_(sql.M) + "SELECT DISTINCT host_id FROM m",
    **{
        f"validate_{level}": (sql.with_(sql.M) if level in ("hourly", "daily") else "") + _rules_sql(level)
        for level in ("hourly", "daily", "weekly", "monthly", "yearly")
    },
    "validation_report": sql.with_(sql.M) + f"SELECT level, {COUNTS_SQL} FROM ({ALL_RULES}) GROUP BY level",
    "validation_sample": SAMPLE_SQL,
    "verify_manifest": VERIFY_SQL,
    "lineage_gaps": LINEAGE_SQL,
    "lineage_counts": LINEAGE_COUNTS_SQL,
    "backfill_missing": BACKFILL_SQL,
    "backfill_last_n": BACKFILL_LAST_SQL,
    "backfill_manifest": MANIFEST_SQL,
    "scheduled_runs": SCHEDULED_SQL,
    "retention_plan": _plan_sql(
        {
            "weekly": "p < DATE '2001-08-02' - INTERVAL 730 DAY",
            "monthly": "p < DATE '2001-08-02' - INTERVAL 1825 DAY",
            "yearly": "p < DATE '2001-08-02' - INTERVAL 3650 DAY",
        }
    ),
    "delete_last_n_plan": _plan_sql(
        {
            "weekly": "p >= DATE '2001-07-30' - INTERVAL 21 DAY",
            "monthly": "p >= DATE '2001-05-01'",
            "yearly": "p >= DATE '1998-01-01'",
        }
    ),
}

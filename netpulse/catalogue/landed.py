"""Queries over files written from the given tables, and over what the data endpoint and the dashboard return."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpulse import config, session
from netpulse.catalogue import sql
from netpulse.catalogue import views as view_queries
from netpulse.catalogue.quality import _key_sql
from netpulse.functions import exact, text, timeparts
from netpulse.operators import oplogs, ordinal, quality, rollup, views
from netpulse.plans import jobs
from netpulse.sinks import tables as sinks
from netpulse.sources import files, logs, tables
from netpulse.sources.normalize import from_speed_bytes, is_valid, normalize

AS_OF = datetime(2024, 1, 31, 6, 0)  # local time just after the last event
LONG_AS_OF = datetime(2001, 8, 2)
LOG_AS_OF = datetime(2024, 1, 31)  # UTC
TEXT_FILES = "*.txt"  # what Spark's text writer names its files


# --- files ------------------------------------------------------------------


def level_inventory(spark, sf_dir):
    """Files of exported days, weeks, months and years, listed with their level, host and period.

    Days are exported a second time, as a repeated run does: no file comes twice.
    """
    folder = session.fresh_folder(spark, "exported")
    days = sinks.written(quality.period_keys(tables.measurements(spark, sf_dir), "daily"), "days")
    for level in ("daily", "daily", "weekly", "monthly", "yearly"):
        keys = quality.coarser_keys(days, level)
        sinks.export_documents(keys.withColumn("doc", F.to_json(F.struct("*"))), level, f"{folder}/{level}")
    listed = files.keyed_inventory(files.inventory(spark, folder, TEXT_FILES))
    return listed.groupBy("level", "host_id", "period_key").agg(
        F.countDistinct(F.regexp_extract("path", "^(.*)/", 1)).alias("folders"), F.bool_and(F.col("size") > 0).alias("filled")
    )


_LABELS = {"daily": "'%Y-%m-%d'", "weekly": "'%G-W%V'", "monthly": "'%Y-%m'", "yearly": "'%Y'"}
_STARTS = {"daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}
# Keys without a host are those of all hosts together; they count as legacy ones, as does the host of that name.
INVENTORY_SQL = (
    sql.with_(sql.M)
    + "SELECT level, CASE WHEN host = 'all' THEN '_legacy' ELSE host END AS host_id, period_key, count(*) AS folders, TRUE AS filled FROM ("
    + " UNION ".join(
        f"SELECT '{level}' AS level, h.host, strftime(date_trunc('{_STARTS[level]}', bucket_start), {label}) AS period_key "
        "FROM m, LATERAL (SELECT unnest([m.host_id, 'all']) AS host) h"
        for level, label in _LABELS.items()
    )
    + ") GROUP BY 1, 2, 3"
)


def _key(level: str, start: Column) -> Column:
    """Keys in every form that is read: hours as ten digits or as two, and months and days that do not exist."""
    host = F.when(F.col("host_id") == config.LEGACY_HOST, "").otherwise(F.concat(F.lit("host="), "host_id", F.lit("/")))

    def part(name: str, pattern: str) -> Column:
        return F.concat(F.lit(f"/{name}="), F.date_format(start, pattern))

    day = F.concat(F.date_format(start, "'year='yyyy"), part("month", "yyyyMM"), part("day", "yyyyMMdd"))
    hour = F.concat(F.lit("/hour="), F.when(F.hour(start) % 2 == 0, F.date_format(start, "yyyyMMddHH")).otherwise(F.date_format(start, "HH")))
    below = {
        "minutes": F.concat(day, part("hour", "yyyyMMddHH"), part("minute", "yyyyMMddHHmm")),
        "hourly": F.concat(day, hour),
        "daily": day,
        "weekly": F.concat(F.date_format(start, "'year='yyyy"), F.lit("/week="), timeparts.iso_week_label(start)),
        "monthly": F.concat(F.date_format(start, "'year='yyyy"), part("month", "yyyyMM")),
        "yearly": F.date_format(start, "'year='yyyy"),
        "wrong": F.concat(F.date_format(start, "'year='yyyy"), F.date_format(start, "'/month='yyyy'13/day='yyyy'1399'")),
        "none": F.date_format(start, "'backup-'yyyyMMdd"),
    }[level]
    return F.concat(host, below, F.lit("/data.json"))


def decoded_keys(spark, sf_dir):
    """Keys of every record at every level, decoded: level, host and period, ``Unknown`` where a key names none."""
    m = tables.measurements(spark, sf_dir)
    forms = ["minutes", "hourly", "daily", "weekly", "monthly", "yearly", "wrong", "none"]
    keys = F.array(*[_key(form, F.col("bucket_start")) for form in forms])
    listed = files.keyed_inventory(m.select(F.explode(keys).alias("path")))
    return listed.groupBy(F.coalesce("level", F.lit("other")).alias("level"), "host_id", "period_key").agg(F.count(F.lit(1)).alias("files"))


_DECODED = {
    "minutes": "strftime(bucket_start, '%Y-%m-%d %H:%M')",
    "hourly": "strftime(bucket_start, '%Y-%m-%d %H:00')",
    **{level: f"strftime(bucket_start, {label})" for level, label in _LABELS.items()},
    "other": "'Unknown'",
}
DECODED_SQL = (
    sql.with_(sql.M)
    + "SELECT level, host_id, period_key, count(*) AS files FROM ("
    + " UNION ALL ".join(f"SELECT '{level}' AS level, host_id, {label} AS period_key FROM m" for level, label in _DECODED.items())
    + " UNION ALL SELECT 'daily', host_id, 'Unknown' FROM m) GROUP BY 1, 2, 3"
)


def document_drift(spark, sf_dir):
    """Documents of four levels under the field names of four ages, exported and read as one table."""
    folder = session.fresh_folder(spark, "documents")
    days = sinks.written(rollup.daily(tables.measurements(spark, sf_dir)), "daily")
    weeks = rollup.weekly(days)
    months = sinks.written(rollup.monthly(days), "monthly")
    years = rollup.yearly(months)

    def renamed(rows: DataFrame, body: Column) -> DataFrame:
        return rows.select("host_id", "period", F.to_json(body).alias("doc"))

    named = {
        "daily": sinks.as_documents(days, "daily"),
        "weekly": sinks.as_documents(weeks, "weekly"),
        "monthly": renamed(
            months,
            F.struct(
                "host_id",
                F.col("avg_download").alias("avg_download_mbps"),
                F.struct(F.col("avg_upload").alias("avg_upload_mbps")).alias("overall"),
                F.col("avg_ping").alias("avg_ping_ms"),
                F.col("days").alias("sample_count"),
            ),
        ),
        "yearly": renamed(
            years,
            F.struct(
                "host_id",
                F.col("avg_download").alias("download_mbps"),
                F.col("avg_upload").alias("upload_mbps"),
                F.col("avg_ping").alias("ping_ms"),
                F.col("months_aggregated").alias("count"),
            ),
        ),
    }
    for level, docs in named.items():
        sinks.export_documents(docs, level, f"{folder}/{level}")
    docs = files.documents(spark, folder, TEXT_FILES, whole=False).withColumnRenamed("key", "path")
    keyed = files.keyed_inventory(docs).drop("host_id")
    return files.drifted_means(keyed).select("level", "host_id", "period_key", "avg_download", "avg_upload", "avg_ping", "samples")


_AVERAGES = ", ".join(f"{sql.hundredth(c)} AS avg_{m}" for c, m in (("dl_c", "download"), ("ul_c", "upload"), ("ping_c", "ping")))
_LEVEL_CTES = (sql.M, sql.DAY_MEANS, sql.coarser("d", "weekly", "w"), sql.coarser("d", "monthly", "mo"), sql.coarser("mo", "yearly", "y"))
DRIFT_SQL = sql.with_(*_LEVEL_CTES) + " UNION ALL ".join(
    f"SELECT '{level}' AS level, host_id, strftime(period, {_LABELS[level]}) AS period_key, {_AVERAGES}, {n} AS samples FROM {cte}"
    for level, cte, n in (("daily", "d", "records"), ("weekly", "w", "n"), ("monthly", "mo", "n"), ("yearly", "y", "n"))
)


def incremental_read(spark, sf_dir):
    """Records whose files came after the newest file of the run before: the second half of the month."""
    folder = session.fresh_folder(spark, "landing")
    raw = tables.raw_measurements(spark, sf_dir).drop("seq", "ts")
    raw = raw.withColumn("bucket_start", timeparts.quarter_hour(F.to_timestamp_ntz(F.substring("timestamp_ist", 1, 19))))
    raw = raw.withColumn("host_id", F.coalesce("host_id", F.lit(config.LEGACY_HOST)))
    first = F.col("bucket_start") < F.lit(datetime(2024, 1, 16)).cast("timestamp_ntz")
    depth = ["year", "month", "day"]
    sinks.land_raw(raw.where(first), folder, depth)
    seen = files.newest(files.inventory(spark, folder))
    sinks.land_raw(raw.where(~first), folder, depth)
    fresh = normalize(files.read_raw(spark, folder, depth=tuple(depth), multiline=False, modified_after=seen))
    return fresh.groupBy("host_id", F.col("bucket_start").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("records"), exact.from_hundredths(F.sum("upload_c")).alias("upload_sum")
    )


INCREMENTAL_SQL = sql.dated(
    sql.with_(sql.M)
    + f"""SELECT host_id, CAST(bucket_start AS DATE) AS date, count(*) AS records, {sql.hundredth('sum(upload_c)')} AS upload_sum
FROM m WHERE bucket_start >= TIMESTAMP '2024-01-16' GROUP BY 1, 2""",
    "date",
)


def log_scan(spark, sf_dir):
    """Lines of the log groups since ten days ago, from JSON files whose time is written in three ways."""
    folder = session.fresh_folder(spark, "logs")
    lines = tables.log_events(spark, sf_dir)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zone = F.element_at(F.array(F.lit("+00:00Z"), F.lit("Z"), F.lit("+00:00")), (F.col("event_id") % 3 + 1).cast("int"))
    lines.select(
        F.concat(stamp, zone).alias("timestamp"), "level", "message", "function", "log_group", "log_stream",
        F.col("event_id").cast("string").alias("event_id"), (F.col("elapsed_c") / 100).alias("elapsed_seconds"),
    ).write.json(folder)
    return oplogs.since(logs.read(spark, folder), LOG_AS_OF, "10d").select(
        F.col("event_id").cast("bigint").alias("event_id"), "ts", "level", "function", "log_group", "log_stream",
        exact.from_hundredths(F.col("elapsed_c")).alias("elapsed_seconds"),
    )


LOG_SCAN_SQL = """SELECT event_id, ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
  'fn_' || (user_id % 4) AS function,
  ['/app/netpulse-aggregator-prod', '/app/netpulse-dashboard-prod', '/app/netpulse-checker-prod'][user_id % 3 + 1] AS log_group,
  'stream-' || (user_id % 10) AS log_stream, CASE WHEN event_type = 'purchase' THEN round(value * 100) / 100 END AS elapsed_seconds
FROM events WHERE ts >= TIMESTAMP '2024-01-21'"""


# --- manifests --------------------------------------------------------------


def _manifests(spark, sf_dir) -> DataFrame:
    days = sinks.written(rollup.daily(tables.long_series(spark, sf_dir)), "daily")
    parts = [jobs.manifest(jobs.backfill(level, days, LONG_AS_OF), level, LONG_AS_OF) for level in ("weekly", "monthly")]
    return sinks.written(parts[0].unionByName(parts[1]), "manifest")


def manifest_table(spark, sf_dir):
    """The files of two backfills in a manifest table; the first is written again, as after a failure."""
    folder = session.fresh_folder(spark, "manifest-table")
    made = _manifests(spark, sf_dir)
    for level in ("weekly", "monthly", "weekly"):
        sinks.write_manifest_run(made.where(F.col("type") == level), folder)
    return sinks.read_summaries(spark, folder).select("timestamp", "type", "bucket", "key")


def manifest_documents(spark, sf_dir):
    """The same files as JSON documents of about a hundred each, read back."""
    folder = session.fresh_folder(spark, "manifest-documents")
    sinks.manifest_documents(_manifests(spark, sf_dir), 100).write.json(folder)
    return files.manifest(spark, folder, multiline=False).select(
        F.to_timestamp_ntz("timestamp").alias("timestamp"), "type", "bucket", "key"
    )


MANIFEST_SQL = sql.with_(sql.O, sql.DAY_MEANS, sql.coarser("d", "weekly", "w"), sql.coarser("d", "monthly", "mo")) + " UNION ALL ".join(
    f"""SELECT TIMESTAMP '2001-08-02 00:00:00' AS timestamp, '{level}' AS type, 'netpulse-{level}' AS bucket, {_key_sql(level)} AS key
FROM {cte} WHERE period < DATE '{current}'"""
    for level, cte, current in (("weekly", "w", "2001-07-30"), ("monthly", "mo", "2001-08-01"))
)


# --- small forms ------------------------------------------------------------


def collector_records(spark, sf_dir):
    """Every order as a collector's reading in bytes a second, in the text form of raw records, and parsed again."""
    landed = tables.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"),
        (F.col("o_custkey") * 9973 + F.col("o_orderkey")).alias("download_bps"),
        (F.col("o_custkey") * 499 + 7).alias("upload_bps"),
        (F.col("o_orderkey").cast("decimal(18,0)") / F.lit(1000).cast("decimal(4,0)")).cast("decimal(18,6)").alias("ping"),
    )
    shown = from_speed_bytes(landed)
    return shown.select(
        "seq", "download_mbps", "upload_mbps", "ping_ms",
        *[text.reading(F.col(c)).alias(f"{c}_c") for c in ("download_mbps", "upload_mbps", "ping_ms")],
    )


def _shown_sql(num: str, den: int) -> tuple[str, str]:
    """Hundredths of a quotient, and its text with two decimals."""
    hundredths = sql.half_up(f"({num}) * 100", str(den))
    return hundredths, f"(CAST({hundredths} // 100 AS VARCHAR) || '.' || lpad(CAST({hundredths} % 100 AS VARCHAR), 2, '0'))"


_READINGS = {
    "download_mbps": (*_shown_sql("(o_custkey * 9973 + o_orderkey) * 8", 1_000_000), "Mbps"),
    "upload_mbps": (*_shown_sql("(o_custkey * 499 + 7) * 8", 1_000_000), "Mbps"),
    "ping_ms": (*_shown_sql("o_orderkey", 1000), "ms"),
}
COLLECTOR_SQL = (
    "SELECT o_orderkey AS seq, "
    + ", ".join(f"{shown} || ' {unit}' AS {name}, CAST({c} AS BIGINT) AS {name}_c" for name, (c, shown, unit) in _READINGS.items())
    + " FROM orders"
)


def shown_values(spark, sf_dir):
    """Readings with their unit, ``N/A`` where there is none."""
    units = {"download": " Mbps", "upload": " Mbps", "ping": " ms"}
    return tables.measurements(spark, sf_dir).select(
        "seq", *[text.with_unit(exact.from_hundredths(F.col(f"{m}_c")), unit).alias(m) for m, unit in units.items()]
    )


SHOWN_SQL = sql.with_(sql.M) + "SELECT seq, " + ", ".join(
    f"coalesce({sql.fixed(f'{m}_c')} || ' {unit}', 'N/A') AS {m}" for m, unit in (("download", "Mbps"), ("upload", "Mbps"), ("ping", "ms"))
) + " FROM m"


def summary_thresholds(spark, sf_dir):
    """The threshold map every daily summary carries, as rows."""
    days = rollup.daily(tables.measurements(spark, sf_dir))
    return days.select("host_id", "period", F.explode("connection_type_thresholds").alias("connection", "expected_mbps"))


THRESHOLDS_SQL = sql.dated(
    sql.with_(sql.M, sql.DAY_MEANS)
    + "SELECT host_id, period, connection, expected_mbps::INTEGER AS expected_mbps FROM d, "
    + "(VALUES ('Wi-Fi 5GHz', 200), ('Wi-Fi 2.4GHz', 100), ('Ethernet', 200), ('Unknown', 150)) t(connection, expected_mbps)",
    "period",
)


def table_order(spark, sf_dir):
    """Places of the rows: ascending by date for the view, descending for the table of the dashboard."""
    rows = views.minute_view(tables.measurements(spark, sf_dir)).select("seq", "date_ist")
    placed = ordinal.with_position(rows.withColumn("mode", F.lit("minute")), ["mode"], ["date_ist", "seq"])
    return placed.select("seq", "date_ist", F.col("pos").alias("view_place"), (F.col("n_rows") - 1 - F.col("pos")).alias("table_place"))


ORDER_SQL = (
    sql.with_(sql.M)
    + """SELECT seq, local_ts AS date_ist, row_number() OVER (ORDER BY local_ts, seq) - 1 AS view_place,
  row_number() OVER (ORDER BY local_ts DESC, seq DESC) - 1 AS table_place FROM v"""
)


# --- data endpoint and dashboard --------------------------------------------

HOSTS = (None, "host-1", config.LEGACY_HOST)
# Days asked for by mode; weeks, months and years are counted in them.
DAYS = {"minute": 20, "hourly": 20, "daily": None, "weekly": 21, "monthly": 360, "yearly": 1095}
_SHOWN = ["date_ist_str", "download_avg", "upload_avg", "ping_avg", "connection_type", "download_anomaly", "ping_anomaly", "below_expected"]


def view_endpoint(spark, sf_dir):
    """What the data endpoint returns in each mode for all hosts, for one host and for records without a host."""
    m = tables.measurements(spark, sf_dir)
    days = sinks.written(rollup.daily(m), "daily")
    long_months = sinks.written(rollup.monthly(rollup.daily(tables.long_series(spark, sf_dir))), "monthly")
    found = {
        "minute": m,
        "hourly": sinks.written(rollup.hourly(m), "hourly"),
        "daily": days,
        "weekly": sinks.written(rollup.weekly(days), "weekly"),
        "monthly": long_months,
        "yearly": sinks.written(rollup.yearly(long_months), "yearly"),
    }
    out = None
    for mode, days_back in DAYS.items():
        as_of = LONG_AS_OF if mode in ("monthly", "yearly") else AS_OF
        for host in HOSTS:
            rows = jobs.view_for(mode, days_back, found, as_of, host)
            part = rows.select(F.lit(mode).alias("mode"), F.lit(host or config.ALL_HOSTS).alias("host"), *_SHOWN)
            out = part if out is None else out.unionByName(part)
    return out


def _endpoint_part(mode: str, ctes: tuple, rows: str) -> str:
    return f"SELECT '{mode}' AS mode, * FROM ({sql.with_(*ctes)} {rows})"


def _coarse_part(mode: str, ctes: tuple, source: str, label: str, first: str) -> str:
    return _endpoint_part(
        mode,
        ctes,
        f"""SELECT host_id AS host, {label} AS date_ist_str, dl_c, ul_c, ping_c,
  CASE WHEN len(types) = 0 THEN 'Unknown' ELSE array_to_string(types, ', ') END AS connection_type FROM {source} WHERE period >= DATE '{first}'""",
    )


def _summary_part(mode: str, label: str, where: str) -> str:
    return _endpoint_part(
        mode,
        (sql.M, sql.summary(mode)),
        f"""SELECT host_id AS host, strftime(period, {label}) AS date_ist_str, download_avg_c AS dl_c, upload_avg_c AS ul_c, ping_avg_c AS ping_c,
  CASE WHEN connection_types = '' THEN 'Unknown' ELSE replace(connection_types, '|', ', ') END AS connection_type FROM s WHERE {where}""",
    )


_ENDPOINT = " UNION ALL ".join(
    [
        _endpoint_part(
            "minute",
            (sql.M,),
            """SELECT h.host, strftime(local_ts, '%Y-%m-%d %H:%M') AS date_ist_str, download_c AS dl_c, upload_c AS ul_c, ping_c,
  coalesce(connection_type, 'Unknown') AS connection_type
FROM v, LATERAL (SELECT unnest([v.host_id, 'all']) AS host) h WHERE local_ts >= TIMESTAMP '2024-01-11 06:00:00'""",
        ),
        _summary_part("hourly", "'%Y-%m-%d %H:00'", "period >= TIMESTAMP '2024-01-11 06:00:00'"),
        _summary_part("daily", "'%Y-%m-%d'", "TRUE"),
        _coarse_part(
            "weekly",
            view_queries.WEEKS,
            "w",
            "strftime(period, '%Y-%m-%d') || ' to ' || strftime(period + INTERVAL 6 DAY, '%Y-%m-%d')",
            "2024-01-10",
        ),
        _coarse_part("monthly", view_queries.MONTHS, "mo", "strftime(period, '%Y-%m')", "2000-08-06"),
        _coarse_part("yearly", view_queries.YEARS, "y", "strftime(period, '%Y')", "1998-01-01"),
    ]
)
ENDPOINT_SQL = f"""WITH x AS (SELECT *, lower(trim(split_part(connection_type, ',', 1))) AS prim FROM ({_ENDPOINT})
  WHERE host IN ('all', 'host-1', '_legacy'))
SELECT mode, host, date_ist_str, {view_queries.AVGS}, connection_type,
  coalesce(dl_c * 10 * count(dl_c) OVER w < 7 * sum(dl_c) OVER w, FALSE) AS download_anomaly,
  coalesce(ping_c * 2 * count(ping_c) OVER w > 3 * sum(ping_c) OVER w, FALSE) AS ping_anomaly,
  coalesce(dl_c < 90 * {view_queries.BELOW}, FALSE) AS below_expected
FROM x WINDOW w AS (PARTITION BY mode, host)"""


def dashboard_statistics(spark, sf_dir):
    """Every statistic of the dashboard over the records of all hosts, as one labelled table."""
    rows = sinks.written(views.minute_view(tables.measurements(spark, sf_dir)), "view")
    return jobs.labelled(jobs.dashboard_bundle(rows, "minute", ["seq"]))


# Part of the bundle: prefix of its SQL, the SQL, the item, the numbers and the text it shows.
_PARTS = {
    "summary": (
        view_queries.MINUTE, view_queries.SUMMARY_SQL, "''",
        ["avg_download", "avg_upload", "avg_ping", "total_tests", "below_expected"], ["top_server_over_period"],
    ),
    "percentiles": (view_queries.MINUTE, view_queries.PERCENTILE_SQL, "''", [f"{m}_p{p}" for m in view_queries.METRICS for p in (50, 95, 99)], []),
    "trends": (view_queries.MINUTE, view_queries.TREND_SQL, "''", [f"{m}_change" for m in (*view_queries.METRICS, "tests")], []),
    "records": (view_queries.DAILY, view_queries.RECORDS_SQL, "record || ' ' || date_ist", ["value"], ["server"]),
    "connection_stats": (
        view_queries.HOURLY, view_queries.CONNECTION_STATS_SQL, "connection",
        ["count", "avg", "threshold", "min_threshold", "below_min", "below_pct"], [],
    ),
    "connection_facets": (view_queries.HOURLY, view_queries.FACETS_SQL, "name", ["count"], []),
    "quick_filters": (
        view_queries.MINUTE, view_queries.ORACLES["quick_filter_counts"], "''", ["below_threshold", "performance_drops", "high_ping"], [],
    ),
    "addresses": (view_queries.MINUTE, view_queries.CIDR_SQL, "cidr", ["count"], []),
    "isps": (view_queries.MINUTE, view_queries.ORACLES["isp_facets"], "name", ["count"], []),
}


def _dashboard_sql() -> str:
    ctes, rows = [], []
    for part, (prefix, query, item, numbers, texts) in _PARTS.items():
        body = query.removeprefix(prefix)
        ctes.append(f"part_{part} AS ({'WITH' + body[1:] if body.startswith(',') else body})")
        for metric in numbers:
            rows.append(f"SELECT '{part}' AS part, {item} AS item, '{metric}' AS metric, CAST(\"{metric}\" AS DOUBLE) AS value, NULL::VARCHAR AS text FROM part_{part}")
        for metric in texts:
            rows.append(f"SELECT '{part}', {item}, '{metric}', NULL, {metric} FROM part_{part}")
    return view_queries.MINUTE.rstrip() + ",\n" + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(rows)


QUERIES = {
    f.__name__: f
    for f in (
        level_inventory, decoded_keys, document_drift, incremental_read, log_scan, manifest_table, manifest_documents,
        collector_records, shown_values, summary_thresholds, table_order, view_endpoint, dashboard_statistics,
    )
}
ORACLES = {
    "level_inventory": INVENTORY_SQL,
    "decoded_keys": DECODED_SQL,
    "document_drift": DRIFT_SQL,
    "incremental_read": INCREMENTAL_SQL,
    "log_scan": LOG_SCAN_SQL,
    "manifest_table": MANIFEST_SQL,
    "manifest_documents": MANIFEST_SQL,
    "collector_records": COLLECTOR_SQL,
    "shown_values": SHOWN_SQL,
    "summary_thresholds": THRESHOLDS_SQL,
    "table_order": ORDER_SQL,
    "view_endpoint": ENDPOINT_SQL,
    "dashboard_statistics": _dashboard_sql(),
}

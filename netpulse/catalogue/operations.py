"""Log, alarm, file-layout and streaming queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netpulse import session
from netpulse.catalogue import rollups, sql
from netpulse.config import ALARMS, COUNTERS
from netpulse.functions import exact, timeparts
from netpulse.operators import oplogs, rollup
from netpulse.plans import jobs
from netpulse.sinks import tables as sinks
from netpulse.sources import files, tables
from netpulse.sources.normalize import is_valid, normalize
from netpulse.streaming import jobs as streams

AS_OF = datetime(2024, 1, 31, 0, 0)

L = """
l AS (SELECT event_id, ts, user_id,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
    CASE event_type WHEN 'purchase' THEN 'Completed successfully: fn_' || (user_id % 4)
      WHEN 'view' THEN 'Aggregated ' || regexp_extract(props, '"k": ([0-9]+)', 1) || ' records'
      ELSE 'Failed: fn_' || (user_id % 4) END AS message,
    'fn_' || (user_id % 4) AS function, ['aggregator', 'dashboard', 'checker'][user_id % 3 + 1] AS source,
    'stream-' || (user_id % 10) AS log_stream,
    CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) END AS elapsed_c
  FROM events)"""


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.log_events(spark, sf_dir)


def log_errors_by_stream(spark, sf_dir):
    return oplogs.errors_by_stream(_logs(spark, sf_dir))


def log_duration_stats(spark, sf_dir):
    return oplogs.duration_stats(_logs(spark, sf_dir))


def log_bins_5m(spark, sf_dir):
    return oplogs.bins(_logs(spark, sf_dir), "failed|error|exception")


def log_latest(spark, sf_dir):
    logs = _logs(spark, sf_dir)
    warned = oplogs.latest(logs, oplogs.matching("WARNING"), 50).withColumn("list", F.lit("warnings"))
    done = oplogs.latest(logs, oplogs.matching(pattern="Completed", any_case=False), 50)
    ran = oplogs.latest(logs, oplogs.matching("INFO", "aggregated"), 20)
    out = warned.unionByName(done.withColumn("list", F.lit("completed")))
    return out.unionByName(ran.withColumn("list", F.lit("aggregated"))).select("list", "event_id", "ts", "message")


def log_lines(spark, sf_dir):
    logs = oplogs.since(_logs(spark, sf_dir), AS_OF, "60d")
    return oplogs.classified(logs).select("event_id", "source", "severity", "message")


def metric_counters(spark, sf_dir):
    counts = oplogs.metric_counters(_logs(spark, sf_dir))
    return counts.select("metric", oplogs.as_time(F.col("w")).alias("window_start"), "n")


def _counter_sql() -> str:
    parts = []
    for c in COUNTERS:
        tests = [f"source = '{c.group}'"]
        if c.level:
            tests.append(f"level = '{c.level}'")
        if c.pattern:
            tests.append(f"regexp_matches(message, '{c.pattern}')")
        parts.append(f"SELECT '{c.metric}' AS metric, ts FROM l WHERE {' AND '.join(tests)}")
    return "c AS (" + " UNION ALL ".join(parts) + ")"


COUNTERS_SQL = (
    sql.with_(L, _counter_sql())
    + "SELECT metric, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n FROM c GROUP BY 1, 2"
)


def monitoring_5m(spark, sf_dir):
    return oplogs.monitoring(_logs(spark, sf_dir))


def alarm_states(spark, sf_dir):
    return oplogs.alarm_states(_logs(spark, sf_dir))


def _alarm_sql() -> str:
    rows = ", ".join(
        f"('{a.name}', '{a.metric}', {a.period_s}, {a.periods}, {a.to_alarm}, {a.threshold}, {a.below}, {a.missing_breaches})"
        for a in ALARMS
    )
    return (
        sql.with_(
            L,
            _counter_sql(),
            f"a AS (SELECT * FROM (VALUES {rows}) t(alarm, metric, p, periods, to_alarm, threshold, below, missing))",
            "e AS (SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS lo, CAST(floor(epoch(max(ts))) AS BIGINT) AS hi FROM l)",
            "sp AS (SELECT a.*, unnest(range(lo - lo % p, hi - hi % p + 1, p)) AS w FROM a, e)",
            "cs AS (SELECT metric, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM c)",
            "n AS (SELECT alarm, s - s % p AS w, count(*) AS n FROM cs JOIN a USING (metric) GROUP BY 1, 2)",
            """b AS (SELECT sp.*, n.n, CAST(CASE WHEN n.n IS NULL THEN missing WHEN below THEN n.n < threshold
    ELSE n.n > threshold END AS INTEGER) AS breach FROM sp LEFT JOIN n USING (alarm, w))""",
        )
        + """SELECT alarm, CAST(to_timestamp(w) AT TIME ZONE 'UTC' AS TIMESTAMP) AS window_start, coalesce(n, 0) AS value, breach = 1 AS breaching,
  CASE WHEN (CASE WHEN periods = 1 THEN breach ELSE breach + coalesce(lag(breach) OVER (PARTITION BY alarm ORDER BY w), 0) END)
    >= to_alarm THEN 'ALARM' ELSE 'OK' END AS state FROM b"""
    )


def alarms_to_date(spark, sf_dir):
    """Alarms up to the morning of the 29th of January, all logs having stopped on the 25th."""
    logs = _logs(spark, sf_dir).where(F.col("ts") < F.lit(datetime(2024, 1, 25)).cast("timestamp_ntz"))
    return oplogs.alarm_states(logs, datetime(2024, 1, 29, 10, 30))


def _alarms_to_date_sql() -> str:
    end = 1706524200  # 2024-01-29 10:30:00 UTC
    out = _alarm_sql()
    for old, new in (
        ("FROM events)", "FROM events WHERE ts < TIMESTAMP '2024-01-25')"),
        ("CAST(floor(epoch(max(ts))) AS BIGINT) AS hi", f"{end - 1} AS hi"),
        ("CASE WHEN n.n IS NULL THEN missing", f"CASE WHEN w + p > {end} AND (below OR n.n IS NULL) THEN false WHEN n.n IS NULL THEN missing"),
    ):
        assert out.count(old) == 1, old
        out = out.replace(old, new)
    return out


def no_data_alarm(spark, sf_dir):
    return oplogs.no_data_periods(tables.measurements(spark, sf_dir))


NO_DATA_SQL = (
    sql.with_(sql.M)
    + """, k AS (SELECT DISTINCT host_id, date_trunc('hour', bucket_start) AS hour FROM m),
s AS (SELECT host_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM k GROUP BY host_id),
q AS (SELECT s.host_id, s.hour, k.hour IS NULL AS silent FROM s LEFT JOIN k ON s.host_id = k.host_id AND s.hour = k.hour)
SELECT host_id, hour FROM (SELECT *, lag(silent) OVER (PARTITION BY host_id ORDER BY hour) AS before FROM q) WHERE silent AND before"""
)


def ongoing_outage(spark, sf_dir):
    """Silent hours of every host up to the end of January, after its last record too."""
    return oplogs.no_data_periods(tables.measurements(spark, sf_dir), as_of=datetime(2024, 2, 1))


ONGOING_SQL = (
    sql.with_(sql.M)
    + """, k AS (SELECT DISTINCT host_id, date_trunc('hour', bucket_start) AS hour FROM m WHERE bucket_start < TIMESTAMP '2024-02-01'),
s AS (SELECT host_id, unnest(generate_series(min(hour), TIMESTAMP '2024-01-31 23:00:00', INTERVAL 1 HOUR)) AS hour FROM k GROUP BY host_id),
q AS (SELECT s.host_id, s.hour, k.hour IS NULL AS silent FROM s LEFT JOIN k ON s.host_id = k.host_id AND s.hour = k.hour)
SELECT host_id, hour FROM (SELECT *, lag(silent) OVER (PARTITION BY host_id ORDER BY hour) AS before FROM q) WHERE silent AND before"""
)


# --- files ------------------------------------------------------------------


def layouts_roundtrip(spark, sf_dir):
    """All records written as JSON in both layouts with one broken file, read back and counted."""
    folder = session.fresh_folder(spark, "layouts")
    raw = tables.raw_measurements(spark, sf_dir).drop("seq", "ts")
    local = F.to_timestamp_ntz(F.substring("timestamp_ist", 1, 19))
    raw = raw.withColumn("bucket_start", timeparts.quarter_hour(local))
    depth = ["year", "month", "day"]
    sinks.land_raw(raw.where(F.col("host_id").isNotNull()), folder, depth)
    sinks.land_raw(raw.where(F.col("host_id").isNull()), folder, depth, legacy=True)
    broken = spark.range(1).select(F.lit('{"download_mbps": "1.0 Mbps", ').alias("value"))
    broken.write.mode("append").text(f"{folder}/host=host-1/year=2024/month=202401/day=20240115")
    back = files.read_raw(
        spark, folder, depth=tuple(depth), multiline=False, name_pattern="*.{json,txt}"
    )
    m = normalize(back)
    return m.groupBy("host_id", F.col("bucket_start").cast("date").alias("date")).agg(
        F.count_if(is_valid()).alias("records"),
        F.count_if(~is_valid()).alias("errors"),
        exact.from_hundredths(F.sum(F.when(is_valid(), F.col("download_c")))).alias("download_sum"),
    )


LAYOUTS_SQL = sql.dated(
    sql.with_(sql.M)
    + f"""SELECT host_id, CAST(bucket_start AS DATE) AS date, count(download_c) AS records,
  count(*) - count(download_c) + CASE WHEN host_id = 'host-1' AND CAST(bucket_start AS DATE) = '2024-01-15' THEN 1 ELSE 0 END AS errors,
  {sql.hundredth('sum(download_c)')} AS download_sum FROM m GROUP BY 1, 2""",
    "date",
)


def summary_table(spark, sf_dir):
    """Daily summaries written by partition, one day run again, and read back."""
    folder = session.fresh_folder(spark, "daily")
    m = tables.measurements(spark, sf_dir)
    days = rollup.daily(m)
    sinks.write_summaries(days, "daily", folder)
    streams.reprocess_date(m, datetime(2024, 1, 10), folder)
    back = sinks.read_summaries(spark, folder)
    return back.select("host_id", "period", "records", F.col("overall.download_mbps.avg").alias("avg_download"))


SUMMARY_TABLE_SQL = sql.dated(
    sql.with_(sql.M, sql.DAY_MEANS)
    + f"SELECT host_id, period, records, {sql.hundredth('dl_c')} AS avg_download FROM d",
    "period",
)


def backfill_write(spark, sf_dir):
    """A daily table that lacks one host on one day, filled by a backfill, written and read back."""
    folder = session.fresh_folder(spark, "backfilled")
    m = tables.measurements(spark, sf_dir)
    lacking = ~((F.col("host_id") == "host-1") & (F.col("period") == F.lit(datetime(2024, 1, 10)).cast("date")))
    sinks.write_summaries(rollup.daily(m).where(lacking), "daily", folder)
    present = sinks.read_summaries(spark, folder).select("host_id", "period")
    built = jobs.backfill("daily", m, datetime(2024, 2, 1), sinks.written(present, "present"), force=True)
    sinks.write_summaries(built, "daily", folder)
    back = sinks.read_summaries(spark, folder)
    return back.select("host_id", "period", "records", F.col("overall.download_mbps.avg").alias("avg_download"))


# --- streams ----------------------------------------------------------------


def _collected(spark: SparkSession, stream: DataFrame, purpose: str) -> DataFrame:
    folder = session.fresh_folder(spark, purpose)
    streams.run_to_table(stream, folder)
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.as_measurements(streams.event_stream(spark, sf_dir))


def stream_hourly(spark, sf_dir):
    return _collected(spark, streams.windowed_rollup(_measured(spark, sf_dir), "hourly"), "hourly")


def stream_daily(spark, sf_dir):
    return _collected(spark, streams.windowed_rollup(_measured(spark, sf_dir), "daily"), "daily")


def _window_sql(unit: str) -> str:
    stats = ", ".join(
        f"{sql.hundredth(sql.mean(c))} AS {m}_avg, {sql.hundredth(f'min({c})')} AS {m}_min, {sql.hundredth(f'max({c})')} AS {m}_max"
        for m, c in (("download_mbps", "dl"), ("upload_mbps", "ul"), ("ping_ms", "pg"))
    )
    return (
        sql.with_(sql.M)
        + f""", g AS (SELECT h.host AS host_id, date_trunc('{unit}', local_ts)::TIMESTAMP AS period, download_c AS dl,
    CASE WHEN download_c IS NOT NULL THEN upload_c END AS ul, CASE WHEN download_c IS NOT NULL THEN ping_c END AS pg
  FROM m, LATERAL (SELECT unnest([m.host_id, 'all']) AS host) h)
SELECT host_id, period, count(dl) AS records, count(*) - count(dl) AS errors, {stats} FROM g
WHERE period + INTERVAL 1 {unit} <= (SELECT max(local_ts) FROM m) - INTERVAL 10 MINUTE
GROUP BY host_id, period HAVING count(dl) > 0"""
    )


def _full(level: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Medians, percentiles and top lists of closed windows, by a stream."""
        folder = session.fresh_folder(spark, f"stream-{level}-full")
        return rollups.flat(spark.read.parquet(streams.run_full_rollup(_measured(spark, sf_dir), level, folder)))

    return run


def _full_sql(level: str, unit: str) -> str:
    closed = f" WHERE period + INTERVAL 1 {unit} <= (SELECT max(bucket_start) FROM m) - INTERVAL 10 MINUTE"
    return rollups.flat_sql(level) + closed


def stream_silence(spark, sf_dir):
    """Hosts that fall silent for 45 minutes and come back; host-3 stops for good on the 20th."""
    m = _measured(spark, sf_dir).where(STOPPED)
    return _collected(spark, streams.host_silence(m, 45), "silence")


STOPPED = "NOT (host_id = 'host-3' AND ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00')"

SILENCE_SQL = (
    sql.with_(sql.M)
    + """, t AS (SELECT host_id, ts, lead(ts) OVER (PARTITION BY host_id ORDER BY ts) AS next FROM
  (SELECT DISTINCT host_id, date_trunc('millisecond', ts) AS ts FROM m WHERE NOT (host_id = 'host-3' AND ts >= TIMESTAMP '2024-01-20 00:00:00'))),
g AS (SELECT *, next IS NULL AS open FROM t WHERE coalesce(next, (SELECT max(ts) FROM t) - INTERVAL 10 MINUTE) >= ts + INTERVAL 45 MINUTE
  AND (next IS NULL OR next > ts + INTERVAL 45 MINUTE))
SELECT host_id, 'silent' AS kind, ts AS last_seen, ts + INTERVAL 45 MINUTE AS at FROM g
UNION ALL SELECT host_id, 'back', ts, next FROM g WHERE NOT open"""
)


def stream_dedup(spark, sf_dir):
    """Every event delivered twice, one of each kept."""
    events = streams.event_stream(spark, sf_dir)
    twice = events.unionByName(streams.event_stream(spark, sf_dir))
    kept = streams.distinct_events(twice, ["event_id"]).select("event_id", "ts", "event_type")
    return _collected(spark, kept, "dedup")


def stream_first_write(spark, sf_dir):
    """Insert-if-absent per host and bucket through a stream of batches."""
    folder = session.fresh_folder(spark, "first")
    columns = ["seq", "ts", "host_id", "bucket_start", "download_c", "upload_c", "ping_c"]
    streams.land_first_writes(_measured(spark, sf_dir).select(*columns), folder)
    landed = spark.read.parquet(f"{folder}/data")
    return landed.select("seq", "ts", "host_id", "bucket_start")


def stream_first_per_bucket(spark, sf_dir):
    m = _measured(spark, sf_dir).select("seq", "ts", "host_id", "connection_type")
    return _collected(spark, streams.first_per_bucket(m), "bucket").select("seq", "ts", "host_id")


FIRST_SQL = """SELECT {columns} FROM (SELECT *,
  row_number() OVER (PARTITION BY host_id, bucket_start ORDER BY ts, seq) AS r FROM m) WHERE r = 1"""


def stream_counters(spark, sf_dir):
    logs = tables.as_log_events(streams.event_stream(spark, sf_dir))
    return _collected(spark, streams.windowed_counters(logs), "counters")


def stream_no_data(spark, sf_dir):
    m = _measured(spark, sf_dir).select("host_id", "ts")
    return _collected(spark, streams.silent_hosts(m, "45 minutes"), "silent")


SILENT_SQL = (
    sql.with_(sql.M)
    + """, g AS (SELECT host_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 45 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM m WINDOW w AS (PARTITION BY host_id ORDER BY ts)),
k AS (SELECT host_id, ts, sum(fresh) OVER (PARTITION BY host_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT host_id, max(ts) AS last_seen, max(ts) + INTERVAL 45 MINUTE AS silent_since, count(*) AS records FROM k
GROUP BY host_id, s HAVING max(ts) + INTERVAL 45 MINUTE <= (SELECT max(ts) FROM m) - INTERVAL 10 MINUTE"""
)

QUERIES = {
    "log_errors_by_stream": log_errors_by_stream,
    "log_duration_stats": log_duration_stats,
    "log_bins_5m": log_bins_5m,
    "log_latest": log_latest,
    "log_lines": log_lines,
    "metric_counters": metric_counters,
    "monitoring_5m": monitoring_5m,
    "alarm_states": alarm_states,
    "alarms_to_date": alarms_to_date,
    "no_data_alarm": no_data_alarm,
    "ongoing_outage": ongoing_outage,
    "layouts_roundtrip": layouts_roundtrip,
    "summary_table": summary_table,
    "backfill_write": backfill_write,
    "stream_hourly": stream_hourly,
    "stream_daily": stream_daily,
    "stream_hourly_full": _full("hourly"),
    "stream_daily_full": _full("daily"),
    "stream_silence": stream_silence,
    "stream_dedup": stream_dedup,
    "stream_first_write": stream_first_write,
    "stream_first_per_bucket": stream_first_per_bucket,
    "stream_counters": stream_counters,
    "stream_no_data": stream_no_data,
}
_L = sql.with_(L)
ORACLES = {
    "log_errors_by_stream": _L + "SELECT log_stream, count(*) AS error_count FROM l WHERE level = 'ERROR' GROUP BY 1",
    "log_duration_stats": _L
    + f"""SELECT function, count(*) AS runs, {sql.hundredth(sql.mean('elapsed_c'))} AS avg_seconds,
  {sql.hundredth('max(elapsed_c)')} AS max_seconds, {sql.hundredth('min(elapsed_c)')} AS min_seconds
FROM l WHERE message LIKE 'Completed%' GROUP BY function""",
    "log_bins_5m": _L
    + """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS lines FROM l
WHERE regexp_matches(lower(message), 'failed|error|exception') GROUP BY 1""",
    "log_latest": _L
    + """SELECT * FROM (SELECT 'warnings' AS list, event_id, ts, message FROM l WHERE level = 'WARNING' ORDER BY ts DESC, event_id DESC LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'completed', event_id, ts, message FROM l WHERE message LIKE '%Completed%' ORDER BY ts DESC, event_id DESC LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'aggregated', event_id, ts, message FROM l WHERE level = 'INFO' AND lower(message) LIKE '%aggregated%' ORDER BY ts DESC, event_id DESC LIMIT 20)""",
    "log_lines": _L
    + """SELECT event_id, source, CASE level WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'info' END AS severity, message FROM l""",
    "metric_counters": COUNTERS_SQL,
    "monitoring_5m": _L
    + f"""SELECT source, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS invocations,
  count(*) FILTER (WHERE level = 'ERROR') AS errors, {sql.hundredth(sql.mean('elapsed_c'))} AS avg_seconds FROM l GROUP BY 1, 2""",
    "alarm_states": _alarm_sql(),
    "alarms_to_date": _alarms_to_date_sql(),
    "no_data_alarm": NO_DATA_SQL,
    "ongoing_outage": ONGOING_SQL,
    "layouts_roundtrip": LAYOUTS_SQL,
    "summary_table": SUMMARY_TABLE_SQL,
    "backfill_write": SUMMARY_TABLE_SQL,
    "stream_hourly": _window_sql("hour"),
    "stream_daily": _window_sql("day"),
    "stream_hourly_full": _full_sql("hourly", "hour"),
    "stream_daily_full": sql.dated(_full_sql("daily", "day"), "period"),
    "stream_silence": SILENCE_SQL,
    "stream_dedup": "SELECT event_id, ts, event_type FROM events",
    "stream_first_write": sql.with_(sql.M) + FIRST_SQL.format(columns="seq, ts, host_id, bucket_start"),
    "stream_first_per_bucket": sql.with_(sql.M)
    + FIRST_SQL.format(columns="seq, ts, host_id")
    + " AND bucket_start + INTERVAL 15 MINUTE <= (SELECT max(local_ts) FROM m) - INTERVAL 10 MINUTE",
    "stream_counters": COUNTERS_SQL.replace(
        "FROM c GROUP BY 1, 2",
        """FROM c WHERE time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE
  <= (SELECT max(ts) FROM l) - INTERVAL 10 MINUTE GROUP BY 1, 2""",
    ),
    "stream_no_data": SILENT_SQL,
}

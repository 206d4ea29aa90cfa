"""The given parquet tables read as measurements, long series and log events.

``measurements`` and ``raw_measurements`` describe the same rows: the second in
the text form collectors write, the first already normalised, so that jobs that
start from landed parquet do not pay for parsing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netpulse.config import LEGACY_HOST, ZONE
from netpulse.functions import timeparts
from netpulse.sources.normalize import MEASUREMENT, with_label

# Event type -> connection type.
CONNECTIONS = {
    "view": "Wi-Fi 5GHz",
    "click": "Wi-Fi 2.4GHz",
    "purchase": "Ethernet",
    "signup": "Wi-Fi (unknown band)",
}
# Log group by user_id % 3.
LOG_GROUPS = ["/app/netpulse-aggregator-prod", "/app/netpulse-dashboard-prod", "/app/netpulse-checker-prod"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _host(key: str) -> str:
    return f"if({key} % 5 = 0, '{LEGACY_HOST}', concat('host-', {key} % 5))"


def _attributes(events: DataFrame) -> DataFrame:
    connection = " ".join(f"when '{event}' then '{kind}'" for event, kind in CONNECTIONS.items())
    return events.selectExpr(
        "event_id as seq",
        "ts",
        f"convert_timezone('UTC', '{ZONE}', ts) as local_ts",
        f"{_host('user_id')} as host_id",
        "cast(round(value * 100) as bigint) as base_c",
        "get_json_object(props, '$.k') as latency",
        "concat('srv-', user_id % 7) as server_name",
        "concat('node-', user_id % 3) as server_host",
        "if(user_id % 4 = 0, '', concat('city-', user_id % 4)) as server_city",
        "if(user_id % 6 = 0, '', concat('C', user_id % 6)) as server_country",
        "if(event_id % 11 = 0, '', concat('https://example.net/r/', event_id)) as result_url",
        """if(event_id % 50 = 7, 'Unknown',
            concat_ws('.', '10', user_id % 3, user_id % 50, event_id % 250)) as public_ip""",
        f"case event_type {connection} end as connection_type",
        "if(event_type in ('view', 'click'), 'home', null) as wifi_name",
        "concat('Host ', user_id % 5) as host_name",
        "concat('site-', user_id % 2) as host_location",
        "concat('isp-', user_id % 3) as host_isp",
    )


# Every 97th record carries a download that does not parse, every 89th no latency.
BAD_DOWNLOAD = "seq % 97 = 0"
NO_PING = "seq % 89 = 0"


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as normalised measurements."""
    return as_measurements(table(spark, sf_dir, "events"))


def as_measurements(events: DataFrame) -> DataFrame:
    df = _attributes(events).selectExpr(
        "*",
        f"if({BAD_DOWNLOAD}, null, base_c * 4) as download_c",
        "base_c * 2 as upload_c",
        f"if({NO_PING}, null, cast(latency as bigint) * 100) as ping_c",
    )
    df = df.withColumn("bucket_start", timeparts.quarter_hour(F.col("local_ts")))
    return with_label(df).select(*MEASUREMENT)


def raw_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` in the text form of collectors."""

    def amount(factor: int) -> str:
        return f"concat(cast(base_c * {factor} / cast(100 as decimal(3,0)) as decimal(18,2)), ' Mbps')"

    return _attributes(table(spark, sf_dir, "events")).selectExpr(
        "seq",
        "ts",
        """concat(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), '+00:00') as timestamp_utc""",
        "concat(date_format(local_ts, 'yyyy-MM-dd HH:mm:ss'), ' IST') as timestamp_ist",
        f"if({BAD_DOWNLOAD}, 'n/a', {amount(4)}) as download_mbps",
        f"{amount(2)} as upload_mbps",
        f"if({NO_PING}, '', concat(latency, ' ms')) as ping_ms",
        "server_name",
        "server_city",
        "server_country",
        "server_host",
        "cast(seq % 1000 as string) as server_id",
        "result_url",
        "public_ip",
        "connection_type",
        "wifi_name",
        f"nullif(host_id, '{LEGACY_HOST}') as host_id",
        "host_name",
        "host_location",
        "host_isp",
    )


def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as measurements over several years."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as seq",
        "o_orderdate as local_ts",
        "o_orderdate as bucket_start",
        "concat('host-', o_custkey % 5) as host_id",
        "cast(round(o_totalprice / 10) as bigint) as download_c",
        "cast(round(o_totalprice / 10) as bigint) div 2 as upload_c",
        "o_orderkey % 60 * 100 as ping_c",
        "concat('srv-', o_custkey % 7) as server_label",
        "concat_ws('.', '10.9', o_custkey % 50, o_orderkey % 250) as public_ip",
        "o_orderpriority as connection_type",
    )


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as structured log lines."""
    return as_log_events(table(spark, sf_dir, "events"))


def as_log_events(events: DataFrame) -> DataFrame:
    groups = ", ".join(f"'{g}'" for g in LOG_GROUPS)
    return events.selectExpr(
        "event_id",
        "ts",
        "case event_type when 'error' then 'ERROR' when 'signup' then 'WARNING' else 'INFO' end as level",
        """case event_type
            when 'purchase' then concat('Completed successfully: fn_', user_id % 4)
            when 'view' then concat('Aggregated ', get_json_object(props, '$.k'), ' records')
            else concat('Failed: fn_', user_id % 4) end as message""",
        "concat('fn_', user_id % 4) as function",
        f"element_at(array({groups}), cast(user_id % 3 + 1 as int)) as log_group",
        "concat('stream-', user_id % 10) as log_stream",
        "if(event_type = 'purchase', cast(round(value * 100) as bigint), null) as elapsed_c",
    )

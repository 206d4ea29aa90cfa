"""Declared schemas; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()

# A measurement as collectors write it: numbers are text with a unit.
RAW_MEASUREMENT = T.StructType(
    [
        T.StructField(name, _S)
        for name in (
            "timestamp_utc", "timestamp_ist", "download_mbps", "upload_mbps", "ping_ms",
            "server_name", "server_city", "server_country", "server_host", "server_id",
            "result_url", "public_ip", "connection_type", "wifi_name",
            "host_id", "host_name", "host_location", "host_isp",
        )
    ]
)

STATS = T.StructType(
    [
        T.StructField(name, T.DoubleType())
        for name in ("avg", "median", "max", "min", "p99", "p95", "p90", "p50")
    ]
)
OVERALL = T.StructType(
    [T.StructField(metric, STATS) for metric in ("download_mbps", "upload_mbps", "ping_ms")]
)

LOG_EVENT = T.StructType(
    [
        T.StructField("timestamp", _S),
        T.StructField("level", _S),
        T.StructField("message", _S),
        T.StructField("function", _S),
        T.StructField("module", _S),
        T.StructField("hostname", _S),
        T.StructField("requestId", _S),
        T.StructField("error", _S),
        T.StructField("elapsed_seconds", T.DoubleType()),
        T.StructField("event_id", _S),
        T.StructField("log_group", _S),
        T.StructField("log_stream", _S),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("timestamp", _S),
        T.StructField("files_created", T.LongType()),
        T.StructField(
            "files",
            T.ArrayType(
                T.StructType([T.StructField(n, _S) for n in ("bucket", "key", "type")])
            ),
        ),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", _S),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", _S),
    ]
)

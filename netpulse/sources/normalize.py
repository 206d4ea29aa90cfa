"""Raw collector records -> the normalised measurement table.

Columns of a normalised measurement:

``seq`` arrival order (BIGINT), ``ts`` UTC instant, ``local_ts`` wall time,
``bucket_start`` its 15-minute bucket, ``host_id``, ``download_c``/``upload_c``/
``ping_c`` in hundredths, the server parts and ``server_label``, ``result_url``,
``public_ip``, ``connection_type``, ``wifi_name``, ``host_name``,
``host_location``, ``host_isp``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpulse.config import LEGACY_HOST, MAX_PING, MIN_DOWNLOAD, MIN_UPLOAD, ZONE
from netpulse.functions import text, timeparts


def parse_local(stamp: Column, zone_name: str = "IST") -> Column:
    """``2025-12-29 14:16:02 IST`` -> wall time; NULL on bad input."""
    body = F.regexp_extract(stamp, rf"^(.{{19}}) {zone_name}$", 1)
    return F.try_to_timestamp(body, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def normalize(raw: DataFrame, zone: str = ZONE) -> DataFrame:
    """Parse units, resolve the host and add the label and the bucket.

    A reading that does not parse becomes NULL; the row is kept so that it can
    be counted as an error. ``raw`` may carry ``seq``, ``ts``, ``host`` (from the
    path), ``bucket_start`` (from the path) and ``corrupt`` already.
    """
    have = set(raw.columns)
    host = [F.col(c) for c in ("host", "host_id") if c in have]
    out = raw.withColumn("host_id", F.coalesce(*host, F.lit(LEGACY_HOST)))
    if "ts" not in have:
        utc = F.try_to_timestamp(F.regexp_replace("timestamp_utc", r"(\+00:00|Z)$", ""))
        out = out.withColumn("ts", utc.cast("timestamp_ntz"))
    local = F.coalesce(parse_local(F.col("timestamp_ist")), timeparts.to_local(F.col("ts"), zone))
    if "local_ts" in have:
        local = F.coalesce(F.col("local_ts"), local)
    out = out.withColumn("local_ts", local)
    bucket = timeparts.quarter_hour(F.col("local_ts"))
    if "bucket_start" in have:  # the path is canonical, the completion time may fall later
        bucket = F.coalesce(F.col("bucket_start"), bucket)
    if "path_start" in have:  # an unreadable record still belongs to its folder's period
        bucket = F.coalesce(bucket, F.col("path_start"))
    out = out.withColumns(
        {
            "bucket_start": bucket,
            "download_c": text.reading(F.col("download_mbps")),
            "upload_c": text.reading(F.col("upload_mbps")),
            "ping_c": text.reading(F.col("ping_ms")),
        }
    )
    if "seq" not in have:
        out = out.withColumn("seq", F.unix_micros(F.col("ts").cast("timestamp")))
    return with_label(out).select(*MEASUREMENT)


MEASUREMENT = [
    "seq", "ts", "local_ts", "bucket_start", "host_id", "download_c", "upload_c", "ping_c",
    "server_name", "server_host", "server_city", "server_country", "server_label",
    "result_url", "public_ip", "connection_type", "wifi_name", "host_name", "host_location",
    "host_isp",
]


def with_label(df: DataFrame) -> DataFrame:
    parts = [F.col(c) for c in ("server_name", "server_host", "server_city", "server_country")]
    return df.withColumn("server_label", text.server_label(*parts))


def is_valid() -> Column:
    """Both speeds parsed; the latency may be missing."""
    return F.col("download_c").isNotNull() & F.col("upload_c").isNotNull()


def is_plausible() -> Column:
    """Optional bounds on a valid measurement."""
    return (
        (F.col("download_c") >= MIN_DOWNLOAD * 100)
        & (F.col("upload_c") >= MIN_UPLOAD * 100)
        & F.coalesce(F.col("ping_c") <= MAX_PING * 100, F.lit(True))
    )


def from_speed_bytes(landed: DataFrame) -> DataFrame:
    """Collector output in bytes per second -> the raw record form.

    Expects ``download_bps``, ``upload_bps`` (bytes per second) and ``ping`` (ms).
    """

    def megabits(c: str) -> Column:
        return F.round(F.col(c).cast("decimal(28,6)") * 8 / 1_000_000, 2)

    return landed.withColumns(
        {
            "download_mbps": F.concat(megabits("download_bps").cast("decimal(18,2)").cast("string"), F.lit(" Mbps")),
            "upload_mbps": F.concat(megabits("upload_bps").cast("decimal(18,2)").cast("string"), F.lit(" Mbps")),
            "ping_ms": F.concat(F.round(F.col("ping").cast("decimal(18,6)"), 2).cast("decimal(18,2)").cast("string"), F.lit(" ms")),
        }
    )

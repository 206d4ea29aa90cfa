"""Presentation rows: every granularity projected to one common shape.

``date_ist, date_ist_str, download_avg, upload_avg, ping_avg, connection_type,
top_server, public_ip, host_id`` plus the extras of a level. Address and URL
lists stay in the long-form member table (``rollup.members``); ``public_ip`` is
the first member in text order.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpulse import config
from netpulse.functions import exact, text, timeparts
from netpulse.operators import anomaly, rollup
from netpulse.sources.normalize import is_valid


def for_host(df: DataFrame, host: str | None) -> DataFrame:
    """Rows of one host; without a host, only the all-hosts rows."""
    return df.where(F.col("host_id") == (host or config.ALL_HOSTS))


def minute_view(measurements: DataFrame, as_of: datetime | None = None, days: int | None = None, host: str | None = None) -> DataFrame:
    """Single measurements; ``host=None`` keeps those of every host."""
    df = measurements.where(is_valid())
    if host and host != config.ALL_HOSTS:
        df = df.where(F.col("host_id") == host)
    if days is not None:
        df = df.where(F.col("local_ts") >= F.lit(as_of - timedelta(days=days)).cast("timestamp_ntz"))
    parts = [F.col(c) for c in ("server_name", "server_host", "server_city", "server_country")]
    blank = F.lit("")
    return df.select(
        "seq",
        F.col("local_ts").alias("date_ist"),
        timeparts.period_label(F.col("local_ts"), "minute").alias("date_ist_str"),
        exact.from_hundredths(F.col("download_c")).alias("download_avg"),
        exact.from_hundredths(F.col("upload_c")).alias("upload_avg"),
        exact.from_hundredths(F.col("ping_c")).alias("ping_avg"),
        text.full_server_label(*parts).alias("top_server"),
        F.coalesce("public_ip", blank).alias("public_ip"),
        F.coalesce("connection_type", F.lit(text.UNKNOWN)).alias("connection_type"),
        F.coalesce("wifi_name", blank).alias("wifi_name"),
        F.when(F.col("result_url") != "", F.array("result_url"))
        .otherwise(F.array().cast("array<string>"))
        .alias("result_urls"),
        "host_id",
        F.coalesce("host_name", blank).alias("host_name"),
        F.coalesce("host_location", blank).alias("host_location"),
        F.coalesce("host_isp", blank).alias("host_isp"),
    )


def first_ip(members: DataFrame) -> DataFrame:
    """Smallest address of each host and period."""
    return (
        members.where(F.col("kind") == "ip")
        .groupBy("host_id", "period")
        .agg(F.min("item").alias("public_ip"))
    )


def period_first_ip(measurements: DataFrame, level: str) -> DataFrame:
    """``first_ip`` straight from measurements: one map-side combined minimum."""
    per_host = (
        measurements.where(is_valid() & (F.col("public_ip") != ""))
        .groupBy("host_id", timeparts.period_of(F.col("bucket_start"), level).alias("period"))
        .agg(F.min("public_ip").alias("public_ip"))
    )
    return rollup.with_all_hosts(per_host).groupBy("host_id", "period").agg(
        F.min("public_ip").alias("public_ip")
    )


def _first_shown(level: str, as_of: datetime, look_back: int) -> datetime:
    """Start of a look-back."""
    if level in ("hourly", "daily"):
        return as_of - timedelta(days=look_back)
    if level == "weekly":
        return as_of - timedelta(weeks=look_back)
    if level == "monthly":
        return as_of.replace(day=1) - timedelta(days=30 * look_back)
    return as_of.replace(year=as_of.year - look_back, month=1, day=1)


def _cut(columns: list[str], level: str, as_of: datetime | None, look_back: int | None) -> Column | None:
    """Look-back condition on ``period`` and on the folders of a stored table; None keeps everything."""
    if look_back is None:
        return None
    first = _first_shown(level, as_of, look_back)
    bound = F.lit(first).cast("timestamp_ntz") if level == "hourly" else F.lit(first.date())
    return (F.col("period") >= bound) & timeparts.in_folders(columns, first)


def view(
    summaries: DataFrame,
    level: str,
    host: str | None = None,
    as_of: datetime | None = None,
    look_back: int | None = None,
    first_ips: DataFrame | None = None,
) -> DataFrame:
    """Common rows of one summary level for one host (or ``all``).

    ``look_back`` counts days for hours and days, else weeks, months or years.
    """
    df = for_host(summaries, host)
    cut = _cut(df.columns, level, as_of, look_back)
    if cut is not None:
        df = df.where(cut)
    common = [
        F.col("period").alias("date_ist"),
        timeparts.period_label(F.col("period"), level).alias("date_ist_str"),
    ]
    types = text.joined(F.col("connection_types")).alias("connection_type")
    if level in ("hourly", "daily"):
        if first_ips is not None:
            df = df.join(for_host(first_ips, host), ["host_id", "period"], "left")
        ip = F.col("public_ip") if first_ips is not None else F.lit(None).cast("string")
        return df.select(
            *common,
            F.col("overall.download_mbps.avg").alias("download_avg"),
            F.col("overall.upload_mbps.avg").alias("upload_avg"),
            F.col("overall.ping_ms.avg").alias("ping_avg"),
            types,
            text.first_or_blank(F.col("servers_top")).alias("top_server"),
            F.coalesce(ip, F.lit("")).alias("public_ip"),
            "records",
            "completion_rate",
            "host_id",
        )
    count = rollup.COUNT_NAME[level]
    return df.select(
        *common,
        F.col("avg_download").alias("download_avg"),
        F.col("avg_upload").alias("upload_avg"),
        F.col("avg_ping").alias("ping_avg"),
        types,
        F.lit("").alias("top_server"),
        F.lit("").alias("public_ip"),
        F.col(count).alias("months" if level == "yearly" else "days"),
        "host_id",
    )


def view_records(view_rows: DataFrame) -> DataFrame:
    """View rows with the anomaly flags, as the data endpoint returns them."""
    return anomaly.flag_rows(view_rows)


def latest_per_period(files: DataFrame) -> DataFrame:
    """Keep the most recently written row of each host and period, by a map-side combined maximum."""
    columns = [c for c in files.columns if c not in ("host_id", "period")]
    newest = F.max_by(F.struct(*columns), F.struct("modified", "path")).alias("_newest")
    return files.groupBy("host_id", "period").agg(newest).select("host_id", "period", "_newest.*")


def prefer_all_hosts(summaries: DataFrame) -> DataFrame:
    """One row per period: the all-hosts row if there is one, else the first host.

    A two-field minimum instead of a window, so a period held by very many hosts
    combines map-side. The chosen host then selects its row.
    """
    order = F.struct((F.col("host_id") != config.ALL_HOSTS).alias("later"), F.col("host_id"))
    chosen = summaries.groupBy("period").agg(F.min(order).alias("_first"))
    chosen = chosen.select("period", F.col("_first.host_id").alias("host_id"))
    return summaries.join(chosen, ["period", "host_id"])


def latest_periods(summaries: DataFrame, n: int) -> DataFrame:
    """The N newest periods, one row each."""
    return prefer_all_hosts(summaries).orderBy(F.desc("period")).limit(n)


def latest_measurements(measurements: DataFrame, n: int) -> DataFrame:
    """The N newest raw measurements by arrival."""
    return measurements.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def advanced_filter(
    rows: DataFrame,
    *,
    start: datetime | None = None,
    end: datetime | None = None,
    download: tuple[float | None, float | None] = (None, None),
    upload: tuple[float | None, float | None] = (None, None),
    ping: tuple[float | None, float | None] = (None, None),
    connection: str | None = None,
    isp: str | None = None,
    ip: str | None = None,
    host: str | None = None,
    threshold: float | None = None,
) -> DataFrame:
    """Conjunction of the filters given; ``ip`` may hold ``*``, ``threshold`` keeps slower rows."""
    tests: list[Column] = []
    if start is not None:
        tests.append(F.col("date_ist") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        tests.append(F.col("date_ist") <= F.lit(end).cast("timestamp_ntz"))
    for column, (low, high) in {
        "download_avg": download,
        "upload_avg": upload,
        "ping_avg": ping,
    }.items():
        if low is not None:
            tests.append(F.col(column) >= low)
        if high is not None:
            tests.append(F.col(column) <= high)
    if connection is not None:
        tests.append(contains_type(connection))
    if isp is not None:
        tests.append(F.lower("host_isp").contains(isp.lower()))
    if ip is not None:
        pattern = ip.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%")
        tests.append(F.col("public_ip").like(pattern))
    if host is not None:
        tests.append(F.col("host_id") == host)
    if threshold is not None:
        tests.append(F.col("download_avg") < threshold)
    for test in tests:
        rows = rows.where(test)
    return rows


def contains_type(name: str) -> Column:
    """Connection type contains the text, whatever the case."""
    return F.lower("connection_type").contains(name.lower())

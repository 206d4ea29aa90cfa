"""Coverage, gaps, duplicates, availability and lineage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpulse import config
from netpulse.functions import exact, timeparts
from netpulse.operators.rollup import with_all_hosts


def list_hosts(measurements: DataFrame) -> DataFrame:
    """Every host seen, legacy data included, sorted."""
    host = F.coalesce("host_id", F.lit(config.LEGACY_HOST)).alias("host_id")
    return measurements.select(host).distinct().orderBy("host_id")


def coverage(measurements: DataFrame, expected: int = 4) -> DataFrame:
    """Distinct 15-minute buckets and records per host and hour, and over all hosts.

    Rows are counted per bucket first (map-side), so the distinct step sees at
    most four buckets of an hour.
    """
    buckets = measurements.groupBy("host_id", "bucket_start").agg(F.count(F.lit(1)).alias("records"))
    per_bucket = (
        with_all_hosts(buckets).groupBy("host_id", "bucket_start").agg(F.sum("records").alias("records"))
    )
    return (
        per_bucket.groupBy("host_id", timeparts.hour_start(F.col("bucket_start")).alias("hour"))
        .agg(F.count(F.lit(1)).alias("distinct_minutes"), F.sum("records").alias("records"))
        .withColumn("coverage_percent", exact.percent(F.col("distinct_minutes"), F.lit(expected)))
    )


def coverage_by_date(hours: DataFrame) -> DataFrame:
    """Hours found and records of each day, from ``coverage``."""
    return hours.groupBy("host_id", F.col("hour").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("total_hours_found"), F.sum("records").alias("total_records")
    )


def missing_periods(present: DataFrame, level: str, within: str, as_of: datetime | None = None) -> DataFrame:
    """Periods of ``level`` a host lacks inside the coarser periods its data spans.

    ``present`` has ``host_id`` and ``period``. The spine is the calendar times the
    hosts, never a product of data rows. With ``as_of`` the spine of every host ends
    before the hour or day it falls in, so an outage that goes on is listed too, and
    later periods are not looked at.
    """
    step = F.expr("interval 1 hour" if level == "hourly" else "interval 1 day")
    local = F.col("period").cast("timestamp_ntz")
    if as_of is not None:
        hour = as_of.replace(minute=0, second=0, microsecond=0)
        until = F.lit(hour if level == "hourly" else hour.replace(hour=0)).cast("timestamp_ntz")
        present = present.where(local < until)
    span = present.groupBy("host_id").agg(F.min(local).alias("first"), F.max(local).alias("last"))
    first = timeparts.period_of(F.col("first"), within).cast("timestamp_ntz")
    last = timeparts.period_of(F.col("last"), within).cast("timestamp_ntz")
    unit = {"daily": "1 day", "weekly": "7 days", "monthly": "1 month", "yearly": "1 year"}[within]
    end = (last + F.expr(f"interval {unit}") if as_of is None else until) - step
    spine = span.select("host_id", F.explode(F.sequence(first, end, step)).alias("period"))
    if level != "hourly":
        spine = spine.withColumn("period", F.col("period").cast("date"))
    parent = timeparts.period_of(F.col("period").cast("timestamp_ntz"), within).alias("within")
    return spine.join(present, ["host_id", "period"], "left_anti").select("host_id", parent, "period")


# --- duplicates -----------------------------------------------------------

KEY = ["level", "host_id", "period_key"]


def inventory_of(measurements: DataFrame) -> DataFrame:
    """Measurements as file rows: ``level, host_id, period_key, path, modified``."""
    return measurements.select(
        F.lit("minutes").alias("level"),
        "host_id",
        F.date_format("bucket_start", "yyyyMMddHHmm").alias("period_key"),
        F.lpad(F.col("seq").cast("string"), 12, "0").alias("path"),
        F.col("ts").alias("modified"),
    )


def duplicate_groups(inventory: DataFrame) -> DataFrame:
    """Groups of files with the same level, host and period key, with their sizes."""
    return (
        inventory.where(F.col("period_key").isNotNull() & (F.col("period_key") != "Unknown"))
        .groupBy(*KEY)
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.min(F.struct("modified", "path")).alias("oldest"),
        )
        .where("files > 1")
    )


def duplicate_totals(inventory: DataFrame) -> DataFrame:
    """Per level: duplicated buckets and surplus files."""
    return duplicate_groups(inventory).groupBy("level").agg(
        F.count(F.lit(1)).alias("buckets"), F.sum(F.col("files") - 1).alias("duplicates")
    )


def files_to_delete(inventory: DataFrame) -> DataFrame:
    """All files but the oldest of each group.

    The oldest is a map-side combined minimum and the surplus an anti-join on the
    unique path, so a group that holds a third of all files is no hot task.
    """
    oldest = inventory.groupBy(*KEY).agg(F.min(F.struct("modified", "path")).alias("o"))
    known = F.col("period_key").isNotNull() & (F.col("period_key") != "Unknown")
    return inventory.where(known).join(oldest.select(F.col("o.path").alias("path")), "path", "left_anti")


def keep_oldest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in ``order``, found without sorting a group."""
    columns = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, "_first.*")


def newest_files(inventory: DataFrame, n: int) -> DataFrame:
    """The N most recently written files."""
    return inventory.orderBy(F.desc("modified"), F.desc("path")).limit(n)


def duplicate_report(inventory: DataFrame, shown: int = 20) -> DataFrame:
    """Files of the newest duplicated buckets, with how many buckets there are in all."""
    groups = duplicate_groups(inventory)
    total = groups.agg(F.count(F.lit(1)))
    newest = groups.orderBy(F.desc("period_key"), "host_id").limit(shown)
    # ``newest`` has at most ``shown`` rows, hence the broadcast.
    return (
        inventory.join(F.broadcast(newest.select(*KEY, "files")), KEY)
        .withColumn("buckets_in_all", total.scalar())
        .withColumn("more_buckets", F.greatest(F.col("buckets_in_all") - shown, F.lit(0)))
    )


def insert_if_absent(incoming: DataFrame, landed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First incoming row of each key that has not landed yet.

    Both sides are reduced to one row per key before they meet.
    """
    first = keep_oldest(incoming, keys, order)
    return first.join(landed.select(*keys).distinct(), keys, "left_anti")


# --- availability and lineage ---------------------------------------------


def period_keys(measurements: DataFrame, level: str) -> DataFrame:
    """Host and period pairs a roll-up of these measurements has, ``all`` included."""
    keys = measurements.select(
        "host_id", timeparts.period_of(F.col("bucket_start"), level).alias("period")
    ).distinct()
    return with_all_hosts(keys).distinct()


def coarser_keys(keys: DataFrame, level: str) -> DataFrame:
    """Host and period pairs of a coarser level, from those of a finer one."""
    start = timeparts.period_of(F.col("period").cast("timestamp_ntz"), level)
    return keys.select("host_id", start.alias("period")).distinct()


def availability(levels: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Per level: rows, first and last period label. Values are (rows, label)."""
    parts = [
        df.select(label.alias("label")).agg(
            F.count(F.lit(1)).alias("periods"),
            F.min("label").alias("first_period"),
            F.max("label").alias("last_period"),
        ).withColumn("level", F.lit(name))
        for name, (df, label) in levels.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def lineage_gaps(days: DataFrame, months: DataFrame, years: DataFrame, as_of: datetime) -> DataFrame:
    """Months with days but no month row, years with months but no year row; open periods excluded."""

    def gap(finer: DataFrame, coarse: DataFrame, level: str) -> DataFrame:
        start = timeparts.period_of(F.col("period").cast("timestamp_ntz"), level)
        open_period = timeparts.period_of(F.lit(as_of).cast("timestamp_ntz"), level)
        wanted = finer.select(start.alias("period")).distinct().where(F.col("period") != open_period)
        return (
            wanted.join(coarse.select("period").distinct(), "period", "left_anti")
            .select(F.lit(f"missing {level}").alias("issue"), "period")
        )

    return gap(days, months, "monthly").unionByName(gap(months, years, "yearly"))


def lineage_counts(levels: dict[str, DataFrame]) -> DataFrame:
    """Distinct periods of each level."""
    out = None
    for name, df in levels.items():
        part = df.agg(F.count_distinct("period").alias("periods")).withColumn("level", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out

"""Comparisons between hosts, periods and hours of the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netpulse.functions import exact
from netpulse.sources.normalize import is_valid

METRICS = ("download", "upload", "ping")


def _means() -> list:
    return [
        exact.from_hundredths(
            exact.mean_hundredths(F.sum(f"{m}_c"), F.count(f"{m}_c"))
        ).alias(f"avg_{m}")
        for m in METRICS
    ]


def hosts(measurements: DataFrame) -> DataFrame:
    """Records and means of each host."""
    return (
        measurements.where(is_valid())
        .groupBy("host_id")
        .agg(F.count(F.lit(1)).alias("records"), *_means())
    )


def hour_of_day(measurements: DataFrame) -> DataFrame:
    """Records and means of each local hour of the day."""
    return (
        measurements.where(is_valid())
        .groupBy(F.hour("local_ts").alias("hour"))
        .agg(F.count(F.lit(1)).alias("records"), *_means())
    )


def period_over_period(periods: DataFrame) -> DataFrame:
    """Each period of a host beside the one listed before it, change in percent.

    ``periods`` is a weekly, monthly or yearly summary: one row per host and period.
    """
    before = W.partitionBy("host_id").orderBy("period")
    c = {m: exact.hundredths(F.col(f"avg_{m}")) for m in METRICS}
    with_previous = periods.select(
        "host_id",
        "period",
        *[f"avg_{m}" for m in METRICS],
        *[c[m].alias(f"{m}_c") for m in METRICS],
        *[F.lag(c[m]).over(before).alias(f"{m}_p") for m in METRICS],
    )

    def change(m: str):
        now, then = F.col(f"{m}_c"), F.col(f"{m}_p")
        tenths = exact.div_half_up((now - then) * 1000, then)
        return (tenths.cast("double") / 10.0).alias(f"{m}_change")

    return with_previous.select(
        "host_id", "period", *[f"avg_{m}" for m in METRICS], *[change(m) for m in METRICS]
    )

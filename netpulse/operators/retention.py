"""Plans of periods to drop: by age, or the last N periods of a level."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpulse.config import LEVELS
from netpulse.functions.timeparts import cutoff_of_last


def _bound(level: str, moment: datetime):
    return F.lit(moment).cast("timestamp_ntz") if level == "hourly" else F.lit(moment.date())


def expired(periods: DataFrame, level: str, as_of: datetime) -> DataFrame:
    """Periods older than the level's retention; none for levels kept for good."""
    ttl = LEVELS[level].ttl_days
    if ttl is None:
        return periods.limit(0)
    return periods.where(F.col("period") < _bound(level, as_of - timedelta(days=ttl)))


def last_n(periods: DataFrame, level: str, as_of: datetime, n: int | None) -> DataFrame:
    """The last N periods, the running one counted first; ``n=None`` takes all."""
    if n is None:
        return periods
    if level == "hourly":  # N hours back from this moment
        return periods.where(F.col("period") >= _bound(level, as_of - timedelta(hours=n)))
    return periods.where(F.col("period") >= _bound(level, cutoff_of_last(level, as_of, n, True)))


def retained(table: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows a plan leaves, to be written as the next version of the table."""
    return table.join(plan.select("host_id", "period").distinct(), ["host_id", "period"], "left_anti")

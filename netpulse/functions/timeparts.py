"""Calendar helpers on local (zone-less) timestamps."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from netpulse.config import TRUNC, ZONE


def to_local(ts: Column, zone: str = ZONE) -> Column:
    """UTC instant without zone -> local wall time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def quarter_hour(local: Column) -> Column:
    """Round down to the 15-minute bucket."""
    past = F.make_dt_interval(mins=(F.minute(local) % 15).cast("int"))
    return (F.date_trunc("minute", local) - past).cast("timestamp_ntz")


def hour_start(local: Column) -> Column:
    return F.date_trunc("hour", local).cast("timestamp_ntz")


def period_of(local: Column, level: str) -> Column:
    """Start of the period a local time falls in: a timestamp for hours, else a date."""
    if level == "hourly":
        return hour_start(local)
    if level == "daily":
        return local.cast("date")
    return F.date_trunc(TRUNC[level], local).cast("date")


def iso_week_label(monday: Column) -> Column:
    """``2025W01``: ISO year and ISO week."""
    return F.concat(
        F.extract(F.lit("yearofweek"), monday).cast("string"),
        F.lit("W"),
        F.lpad(F.weekofyear(monday).cast("string"), 2, "0"),
    )


def period_label(start: Column, level: str) -> Column:
    """Display label of a period."""
    if level == "minute":
        return F.date_format(start, "yyyy-MM-dd HH:mm")
    if level == "hourly":
        return F.date_format(start, "yyyy-MM-dd HH:00")
    if level == "daily":
        return F.date_format(start, "yyyy-MM-dd")
    if level == "weekly":
        end = F.date_add(start, 6)
        return F.concat(
            F.date_format(start, "yyyy-MM-dd"), F.lit(" to "), F.date_format(end, "yyyy-MM-dd")
        )
    return F.date_format(start, "yyyy-MM" if level == "monthly" else "yyyy")


def previous_period(level: str, as_of: datetime) -> datetime:
    """Start of the last completed period before ``as_of`` (local time)."""
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    if level == "hourly":
        return as_of.replace(minute=0, second=0, microsecond=0) - timedelta(hours=1)
    if level == "daily":
        return day - timedelta(days=1)
    if level == "weekly":
        return day - timedelta(days=day.weekday() + 7)
    if level == "monthly":  # month to date up to yesterday
        return (day - timedelta(days=1)).replace(day=1)
    # yearly: the first week of January still closes the year before
    year = day.year - 1 if day.month == 1 and day.day <= 7 else day.year
    return day.replace(year=year, month=1, day=1)


def cutoff_of_last(level: str, as_of: datetime, n: int, count_current: bool) -> datetime:
    """First period start kept by "the last N periods".

    ``count_current``: the period ``as_of`` falls in is the first of the N;
    otherwise N periods before it are kept as well.
    """
    back = n - 1 if count_current else n
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    if level == "hourly":
        return as_of.replace(minute=0, second=0, microsecond=0) - timedelta(hours=back)
    if level == "daily":
        return day - timedelta(days=back)
    if level == "weekly":
        return day - timedelta(days=day.weekday(), weeks=back)
    if level == "monthly":
        index = day.year * 12 + day.month - 1 - back
        return day.replace(year=index // 12, month=index % 12 + 1, day=1)
    return day.replace(year=day.year - back, month=1, day=1)


def look_back(mode: str, days: int) -> int:
    """Days asked for, in the unit of the mode: weeks, 30-day months or 365-day years."""
    return days // {"weekly": 7, "monthly": 30, "yearly": 365}.get(mode, 1)


def parse_since(text: str) -> timedelta:
    """``30m``, ``1h``, ``2d``; anything else is five minutes."""
    found = re.match(r"(\d+)([mhd])", text.lower())
    if not found:
        return timedelta(minutes=5)
    unit = {"m": "minutes", "h": "hours", "d": "days"}[found.group(2)]
    return timedelta(**{unit: int(found.group(1))})


# Partition columns of stored tables, finest first, with the value a moment has in them.
_FOLDERS = (("day", "%Y%m%d"), ("month", "%Y%m"), ("year", "%Y"))


def in_folders(columns: list[str], start: datetime, end: datetime | None = None) -> Column:
    """True in the folders (``year``, ``month``, ``day``) that hold rows from ``start`` up to ``end``.

    The condition on the time of the rows decides; this one, beside it, keeps other
    folders closed. A frame without such columns has no folders: always true.
    """
    within = F.lit(True)
    for name, pattern in _FOLDERS:
        if name in columns:
            low, high = (int(d.strftime(pattern)) if d is not None else None for d in (start, end))
            within = within & (F.col(name) >= low)
            if high is not None:
                within = within & (F.col(name) <= high)
    return within

"""Composite jobs: one scheduled roll-up, the backfill of a level, the dashboard bundle."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpulse import config
from netpulse.functions import timeparts
from netpulse.operators import anomaly, dashboard, downsample, quality, rollup, views

SOURCE_OF = {"weekly": "daily", "monthly": "daily", "yearly": "monthly"}


def build(level: str, source: DataFrame) -> DataFrame:
    """Summaries of a level from its source: measurements, daily or monthly summaries."""
    return {
        "hourly": rollup.hourly,
        "daily": rollup.daily,
        "weekly": rollup.weekly,
        "monthly": rollup.monthly,
        "yearly": rollup.yearly,
    }[level](source)


def period_column(level: str) -> str:
    """Time column of the level's source."""
    return "bucket_start" if level in ("hourly", "daily") else "period"


def run(level: str, source: DataFrame, as_of: datetime, date: datetime | None = None) -> DataFrame:
    """The scheduled roll-up: the last completed period, or the day given for ``daily``.

    The condition is on the time of the rows and on the folders of a source that is
    a stored table (``year``, ``month`` as YYYYMM, ``day`` as YYYYMMDD).
    """
    start = date if date is not None else timeparts.previous_period(level, as_of)
    end = {
        "hourly": start + timedelta(hours=1),
        "daily": start + timedelta(days=1),
        "weekly": start + timedelta(days=7),
        "monthly": (start.replace(day=1) + timedelta(days=32)).replace(day=1),
        "yearly": start.replace(year=start.year + 1),
    }[level]
    if level == "monthly":  # month to date up to yesterday
        end = min(end, as_of.replace(hour=0, minute=0, second=0, microsecond=0))
    if level == "yearly":  # up to the month that is running
        end = min(end, (as_of.replace(day=1) + timedelta(days=32)).replace(day=1))
    when = F.col(period_column(level)).cast("timestamp_ntz")
    within = (when >= F.lit(start).cast("timestamp_ntz")) & (when < F.lit(end).cast("timestamp_ntz"))
    within = within & timeparts.in_folders(source.columns, start, end)
    return build(level, source.where(within))


def backfill(
    level: str,
    source: DataFrame,
    as_of: datetime,
    existing: DataFrame | None = None,
    force: bool = False,
    last: int | None = None,
) -> DataFrame:
    """All periods of a level that can be built, in one job.

    Open periods are left out unless forced, ``last`` keeps the last N periods,
    and periods that ``existing`` (``host_id, period``) holds in full are not built
    again. A period that lacks any host is built whole, all hosts together included,
    since a written period replaces all rows of the one before. Source rows of
    periods with nothing to build are dropped before the roll-up.
    """
    when = F.col(period_column(level)).cast("timestamp_ntz")
    period = timeparts.period_of(when, level)
    rows = source.withColumn("_period", period)
    current = timeparts.period_of(F.lit(as_of).cast("timestamp_ntz"), level)
    if not force:
        rows = rows.where(F.col("_period") < current)
    if last is not None:
        # Years count the running one as the first, the other levels do not.
        first = timeparts.cutoff_of_last(level, as_of, last, level == "yearly")
        bound = F.lit(first).cast("timestamp_ntz")
        rows = rows.where(F.col("_period") >= (bound if level == "hourly" else bound.cast("date")))
        rows = rows.where(timeparts.in_folders(source.columns, first))
    if existing is None:
        return build(level, rows.drop("_period"))
    have = existing.select("host_id", "period").distinct()
    keys = rows.select("host_id", F.col("_period").alias("period")).distinct()
    if level in ("hourly", "daily"):  # measurements carry no all-hosts rows yet
        keys = rollup.with_all_hosts(keys).distinct()
    absent = keys.join(have, ["host_id", "period"], "left_anti").select(F.col("period").alias("_period")).distinct()
    rows = rows.join(absent, "_period", "left_semi")
    return build(level, rows.drop("_period"))


def path_of(level: str) -> Column:
    """Storage key of a summary row (``host_id``, ``period``)."""
    start = F.col("period")

    def part(name: str, pattern: str) -> Column:
        return F.concat(F.lit(f"{name}="), F.date_format(start, pattern))

    host = F.when(F.col("host_id") != config.ALL_HOSTS, F.concat(F.lit("host="), "host_id"))
    parts = [part("year", "yyyy")]
    if level in ("hourly", "daily", "monthly"):
        parts.append(part("month", "yyyyMM"))
    if level in ("hourly", "daily"):
        parts.append(part("day", "yyyyMMdd"))
    if level == "hourly":
        parts.append(part("hour", "yyyyMMddHH"))
    if level == "weekly":
        parts.append(F.concat(F.lit("week="), timeparts.iso_week_label(start)))
    return F.concat_ws("/", F.lit("aggregated"), host, *parts, F.lit("summary.json"))


def manifest(built: DataFrame, level: str, as_of: datetime) -> DataFrame:
    """One row per summary a job produced."""
    return built.select(
        F.lit(as_of).cast("timestamp_ntz").alias("timestamp"),
        F.lit(level).alias("type"),
        F.lit(f"netpulse-{level}").alias("bucket"),
        path_of(level).alias("key"),
    )


def view_for(
    mode: str,
    days: int | None,
    tables: dict[str, DataFrame],
    as_of: datetime,
    host: str | None = None,
) -> DataFrame:
    """View rows with flags for a mode, as the data endpoint serves them.

    ``tables`` holds the measurements under ``minute`` and the summary tables under
    their level; ``days`` is turned into the unit of the mode. Days are not cut
    unless asked for: the daily mode shows all of them when ``days`` is None.
    """
    if mode == "minute":
        rows = views.minute_view(tables["minute"], as_of, days, host)
    else:
        back = None if days is None else timeparts.look_back(mode, days)
        rows = views.view(tables[mode], mode, host, as_of, back)
    return views.view_records(rows).orderBy("date_ist")


def dashboard_bundle(view_rows: DataFrame, mode: str, tie_break: list[str]) -> dict[str, DataFrame]:
    """Every statistic of the dashboard over one view.

    The caller may persist ``view_rows``: each part is a small aggregate of it.
    """
    flagged = anomaly.flag_rows(view_rows)
    parts = {
        "rows": flagged.orderBy(F.desc("date_ist")),
        "summary": dashboard.summary_stats(flagged),
        "percentiles": dashboard.linear_percentiles(flagged),
        "trends": dashboard.trend_halves(flagged, tie_break),
        "records": dashboard.historical_records(flagged),
        "connection_stats": dashboard.connection_stats(flagged),
        "connection_facets": dashboard.connection_facets(flagged),
        "quick_filters": dashboard.quick_filter_counts(flagged),
        "chart": downsample.chart_series(flagged, ["host_id"], tie_break, config.LEVELS[mode].chart_points),
    }
    if mode in ("daily", "hourly", "minute"):
        parts["addresses"] = dashboard.cidr_groups(flagged)
    else:
        parts["below_periods"] = dashboard.below_expected_periods(flagged)
    if "host_isp" in view_rows.columns:
        parts["isps"] = dashboard.isp_facets(flagged)
    return parts


# Parts of a bundle that are rows of the view and not statistics of it.
_ROW_PARTS = ("rows", "chart")


def labelled(parts: dict[str, DataFrame]) -> DataFrame:
    """The statistics of a bundle as one table: ``part, item, metric, value, text``.

    Text columns of a part name the item (a connection, a network, a record with its date); each number is a row with
    ``value``. A part of one row and no text has an empty item. The server of a record and of the summary is a ``text``.
    """
    out = None
    for name, df in parts.items():
        if name in _ROW_PARTS:
            continue
        shown = [c for c in df.columns if c in ("server", "top_server_over_period")]
        numbers = [c for c, kind in df.dtypes if kind != "string" and c != "date_ist"]
        named = [c for c in df.columns if c not in shown and c not in numbers]
        cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(None).cast("string").alias("text")) for c in numbers]
        cells += [F.struct(F.lit(c).alias("metric"), F.lit(None).cast("double").alias("value"), F.col(c).alias("text")) for c in shown]
        item = F.concat_ws(" ", *[F.col(c).cast("string") for c in named])
        rows = df.select(F.lit(name).alias("part"), item.alias("item"), F.inline(F.array(*cells)))
        out = rows if out is None else out.unionByName(rows)
    return out


def availability(measurements: DataFrame, summaries: dict[str, DataFrame]) -> DataFrame:
    """Rows and first and last label of the raw data and of each level given."""
    levels = {"minutes": (measurements, timeparts.period_label(F.col("bucket_start"), "minute"))}
    for name, df in summaries.items():
        levels[name] = (df, timeparts.period_label(F.col("period"), name))
    return quality.availability(levels)

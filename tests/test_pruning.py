"""Runs, backfills and views of stored tables open only the folders they need."""

from datetime import date, datetime

import pytest

from netpulse.operators import rollup, views
from netpulse.plans import jobs
from netpulse.sinks import tables as sinks
from netpulse.sources import tables

AS_OF = datetime(2024, 1, 31, 6)


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("stored")
    m = tables.measurements(spark, sf_dir)
    days = sinks.written(rollup.daily(m), "days")
    months = sinks.written(rollup.monthly(days), "months")
    levels = {
        "hourly": rollup.hourly(m), "daily": days, "weekly": rollup.weekly(days), "monthly": months, "yearly": rollup.yearly(months),
    }
    out = {}
    for level, rows in levels.items():
        sinks.write_summaries(rows, level, str(root / level))
        out[level] = sinks.read_summaries(spark, str(root / level))
    sinks.with_day(m).write.partitionBy("day").parquet(str(root / "minute"))
    out["minute"] = spark.read.parquet(str(root / "minute"))
    return out


def pruned(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    return bool(filters) and all(">=" in f for f in filters)


SOURCE = {"hourly": "minute", "daily": "minute", "weekly": "daily", "monthly": "daily", "yearly": "monthly"}


@pytest.mark.parametrize("level", SOURCE)
def test_scheduled_runs_and_backfills(spark, stored, level):
    source = stored[SOURCE[level]]
    ran = jobs.run(level, source, AS_OF)
    assert pruned(ran)
    assert pruned(jobs.backfill(level, source, AS_OF, last=2))
    plain = source.drop("year", "month", "day")
    assert ran.count() == jobs.run(level, plain, AS_OF).count()
    # The small table has no reading in the last hour.
    assert level == "hourly" or ran.count() > 0


@pytest.mark.parametrize("level", SOURCE)
def test_views(stored, level):
    shown = views.view(stored[level], level, None, AS_OF, 1)
    assert pruned(shown)
    assert shown.count() == views.view(stored[level].drop("year", "month", "day"), level, None, AS_OF, 1).count() > 0


def test_a_week_over_new_year(spark, tmp_path):
    """A week that begins in one year and belongs to the next is found from either side."""
    rows = spark.createDataFrame(
        [("all", date(2024, 12, 30), 1.0, 1.0, 1.0, ["x"], 7)],
        "host_id string, period date, avg_download double, avg_upload double, avg_ping double, connection_types array<string>, days long",
    )
    sinks.write_summaries(rows, "weekly", str(tmp_path / "w"))
    weeks = sinks.read_summaries(spark, str(tmp_path / "w"))
    assert views.view(weeks, "weekly", None, datetime(2025, 1, 8), 1).count() == 0
    assert views.view(weeks, "weekly", None, datetime(2025, 1, 8), 2).count() == 1

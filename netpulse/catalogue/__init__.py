"""Every registered query with the SQL it is checked against."""

from __future__ import annotations

import importlib
from functools import wraps

from pyspark.sql import functions as F

MODULES = ("rollups", "views", "quality", "operations", "runs", "landed")


def _gather(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(getattr(importlib.import_module(f"netpulse.catalogue.{module}"), name))
    return found


def _dates_as_text(query):
    """Dates leave a registered query as text, which every client reads alike."""

    @wraps(query)
    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        dates = {name: F.col(name).cast("string") for name, kind in df.dtypes if kind == "date"}
        return df.withColumns(dates) if dates else df

    return run


def queries() -> dict:
    return {name: _dates_as_text(query) for name, query in _gather("QUERIES").items()}


def oracles() -> dict:
    return _gather("ORACLES")

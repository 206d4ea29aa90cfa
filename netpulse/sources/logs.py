"""Structured log lines from files, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netpulse.schemas import LOG_EVENT


def log_time(stamp: Column) -> Column:
    """``...+00:00Z`` (zone written twice), ``...Z`` or ``...+00:00`` -> UTC time."""
    body = F.regexp_replace(stamp, r"(\+00:00)?Z?$", "")
    return F.try_to_timestamp(body).cast("timestamp_ntz")


def _typed(lines: DataFrame) -> DataFrame:
    return lines.withColumns(
        {
            "ts": log_time(F.col("timestamp")),
            "elapsed_c": F.round(F.col("elapsed_seconds") * 100).cast("bigint"),
        }
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.read.schema(LOG_EVENT).json(path))


def stream(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark.readStream.schema(LOG_EVENT).json(path))

"""Anomaly rules on periods and on view rows.

Comparisons with a mean are written as comparisons of exact sums, so no rounding
decides a flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpulse import config
from netpulse.functions import exact, text


def threshold_map() -> Column:
    """The constant threshold map carried by summaries."""
    return F.create_map(*[F.lit(x) for pair in config.THRESHOLDS.items() for x in pair])


def expected_speed(connection: Column) -> Column:
    """Exact look-up of a connection type, 200 when it is not listed."""
    return F.coalesce(F.try_element_at(threshold_map(), connection), F.lit(config.DEFAULT_EXPECTED))


def view_expected_speed(connections: Column) -> Column:
    """First listed type contained in the primary connection, whatever the case; else 150."""
    primary = F.lower(text.primary_connection(connections))
    rule = F.lit(None).cast("int")
    for name, speed in reversed(config.THRESHOLDS.items()):
        rule = F.when(primary.contains(name.lower()), F.lit(speed)).otherwise(rule)
    return F.coalesce(rule, F.lit(config.DEFAULT_VIEW_EXPECTED))


def _two_decimals(hundredths: Column) -> Column:
    return (hundredths.cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string")


def data_warnings(expected: int) -> dict[str, Column]:
    """Fewer than 80 % of the expected records; more than five errors."""
    return {
        "low_data": F.col("records") * 10 < int(expected * config.LOW_COMPLETION * 10),
        "high_errors": F.col("errors") > config.MAX_ERRORS,
    }


def with_period_anomalies(wide: DataFrame, level: str) -> DataFrame:
    """Add ``threshold_mbps``, ``anomalies``, the warnings and the threshold map."""
    expected = F.col("threshold_mbps")
    limit_c = expected * (100 - config.TOLERANCE_PERCENT)  # hundredths of the tolerated speed
    n, total = F.col("download_mbps_n"), F.col("download_mbps_sum")
    ping_n, ping_total = F.col("ping_ms_n"), F.col("ping_ms_sum")
    low, high_ping = F.col("download_mbps_min"), F.col("ping_ms_max")
    avg = _two_decimals(exact.mean_hundredths(total, n))
    avg_ping = _two_decimals(exact.mean_hundredths(ping_total, ping_n))
    limit = _two_decimals(limit_c)

    # The message texts and the limits in them.
    def message(fmt: str, *parts: Column) -> Column:
        return F.format_string(fmt, *parts)

    rules = [
        F.when(total < limit_c * n, message("Below threshold: avg download %s Mbps < %s Mbps", avg, limit)),
        F.when(low * 2 < limit_c, message("Severe degradation: min download %s Mbps", _two_decimals(low))),
        F.when(
            (expected == 100) & (total < 8000 * n),
            message("Performance drop: avg download %s Mbps < 80 Mbps (2.4GHz threshold)", avg),
        ).when(
            (expected >= 200) & (total < 15000 * n),
            message("Performance drop: avg download %s Mbps < 150 Mbps", avg),
        ),
        F.when(ping_total > 2000 * ping_n, message("High latency: avg ping %s ms", avg_ping)),
        F.when(high_ping > 5000, message("Latency spike: max ping %s ms", _two_decimals(high_ping))),
    ]
    if level == "daily":
        rules.append(
            F.when(
                F.col("low_data"),
                message("Low completion rate: %s%%", F.col("completion_rate").cast("decimal(20,1)").cast("string")),
            )
        )
    wanted = config.LEVELS[level].expected
    return (
        wide.withColumns(
            {
                "threshold_mbps": expected_speed(F.col("top_connection")),
                **data_warnings(wanted),
                "connection_type_thresholds": threshold_map(),
            }
        )
        .withColumn("anomalies", F.array_compact(F.array(*rules)))
    )


def flag_rows(view: DataFrame) -> DataFrame:
    """``download_anomaly``, ``ping_anomaly`` against the means of the whole view, ``below_expected``.

    The means come from one scalar subquery over a one-row aggregate; rows are not
    moved. ``view`` is read twice, so it should be a table, not a chain of jobs.
    """
    down, ping = exact.hundredths(F.col("download_avg")), exact.hundredths(F.col("ping_avg"))
    whole = view.agg(
        F.sum(down).alias("down_sum"),
        F.count("download_avg").alias("down_n"),
        F.sum(ping).alias("ping_sum"),
        F.count("ping_avg").alias("ping_n"),
    )

    def scalar(name: str) -> Column:
        return F.col(f"_whole.{name}")

    flagged = view.withColumn("_whole", whole.select(F.struct("*")).scalar()).withColumns(
        {
            "download_anomaly": F.coalesce(
                down.cast(exact.WIDE) * 10 * scalar("down_n") < scalar("down_sum").cast(exact.WIDE) * 7,
                F.lit(False),
            ),
            "ping_anomaly": F.coalesce(
                ping.cast(exact.WIDE) * 2 * scalar("ping_n") > scalar("ping_sum").cast(exact.WIDE) * 3,
                F.lit(False),
            ),
        }
    )
    return flag_below_expected(flagged.drop("_whole"))


def flag_below_expected(view: DataFrame) -> DataFrame:
    limit_c = view_expected_speed(F.col("connection_type")) * (100 - config.TOLERANCE_PERCENT)
    below = exact.hundredths(F.col("download_avg")) < limit_c
    return view.withColumn("below_expected", F.coalesce(below, F.lit(False)))

"""Analytics over structured log lines: filters, statistics, counters, alarms."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netpulse import config
from netpulse.functions import exact, text, timeparts

STEP = 300  # seconds; divides every alarm period


def since(logs: DataFrame, as_of: datetime, ago: str) -> DataFrame:
    """Lines since ``30m``, ``1h`` or ``2d`` before the moment given."""
    start = F.lit(as_of - timeparts.parse_since(ago)).cast("timestamp_ntz")
    return logs.where(F.col("ts") >= start)


def matching(level: str | None = None, pattern: str | None = None, any_case: bool = True) -> Column:
    """Condition on the level and on the message text."""
    test = F.lit(True)
    if level is not None:
        test = test & (F.col("level") == level)
    if pattern is not None:
        test = test & F.col("message").rlike(("(?i)" if any_case else "") + pattern)
    return test


def classified(logs: DataFrame) -> DataFrame:
    """Lines with the function of their group and a severity; run markers dropped."""
    return logs.withColumns(
        {
            "source": text.function_of_group(F.col("log_group"), "netpulse-"),
            "severity": text.severity(F.concat_ws(" ", "level", "message")),
        }
    ).where(F.col("severity").isNotNull())


def errors_by_stream(logs: DataFrame) -> DataFrame:
    return logs.where(matching("ERROR")).groupBy("log_stream").agg(F.count(F.lit(1)).alias("error_count"))


def duration_stats(logs: DataFrame) -> DataFrame:
    """Mean, longest and shortest duration of completed functions.

    The duration comes from the field, or from text such as ``in 1.25s``.
    """
    c = F.coalesce("elapsed_c", exact.hundredths(text.duration_in_text(F.col("message"))))
    done = logs.where(matching(pattern="Completed", any_case=False)).select(
        text.completed_function(F.col("message")).alias("function"), c.alias("c")
    )
    return (
        done.where(F.col("function").isNotNull() & F.col("c").isNotNull())
        .groupBy("function")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            exact.from_hundredths(exact.mean_hundredths(F.sum("c"), F.count("c"))).alias("avg_seconds"),
            exact.from_hundredths(F.max("c")).alias("max_seconds"),
            exact.from_hundredths(F.min("c")).alias("min_seconds"),
        )
    )


def window_start(ts: Column, seconds: int | Column) -> Column:
    """Start of the window of so many seconds, counted from the epoch, as seconds."""
    at = F.unix_seconds(ts.cast("timestamp"))
    return at - at % seconds


def as_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def bins(logs: DataFrame, pattern: str, seconds: int = STEP) -> DataFrame:
    """Matching lines per window."""
    return (
        logs.where(matching(pattern=pattern))
        .groupBy(window_start(F.col("ts"), seconds).alias("w"))
        .agg(F.count(F.lit(1)).alias("lines"))
        .select(as_time(F.col("w")).alias("window_start"), "lines")
    )


def latest(logs: DataFrame, condition: Column, n: int) -> DataFrame:
    return logs.where(condition).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def counted_metrics() -> Column:
    """Names of the counters a line adds to."""
    group = text.function_of_group(F.col("log_group"), "netpulse-")
    return F.array_compact(
        F.array(
            *[
                F.when((group == c.group) & matching(c.level, c.pattern, any_case=False), F.lit(c.metric))
                for c in config.COUNTERS
            ]
        )
    )


def metric_counters(logs: DataFrame, seconds: int = STEP) -> DataFrame:
    """``metric, w, n``: counter sums per window."""
    return (
        logs.select("ts", F.explode(counted_metrics()).alias("metric"))
        .groupBy("metric", window_start(F.col("ts"), seconds).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def monitoring(logs: DataFrame) -> DataFrame:
    """Five-minute series per log group: lines, errors and mean duration."""
    c = F.col("elapsed_c")
    return (
        logs.groupBy(
            text.function_of_group(F.col("log_group"), "netpulse-").alias("source"),
            window_start(F.col("ts"), STEP).alias("w"),
        )
        .agg(
            F.count(F.lit(1)).alias("invocations"),
            F.count_if(F.col("level") == "ERROR").alias("errors"),
            exact.from_hundredths(exact.mean_hundredths(F.sum(c), F.count(c))).alias("avg_seconds"),
        )
        .select("source", as_time(F.col("w")).alias("window_start"), "invocations", "errors", "avg_seconds")
    )


def _alarm_rows() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(a.name).alias("alarm"),
                F.lit(a.metric).alias("metric"),
                F.lit(a.period_s).cast("bigint").alias("period_s"),
                F.lit(a.periods).alias("periods"),
                F.lit(a.to_alarm).alias("to_alarm"),
                F.lit(a.threshold).alias("threshold"),
                F.lit(a.below).alias("below"),
                F.lit(a.missing_breaches).alias("missing_breaches"),
            )
            for a in config.ALARMS
        ]
    )


def alarm_states(logs: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """State of each alarm in each of its periods.

    Lines are counted once per five minutes; alarm periods are sums of those
    counts, laid on a spine of all periods between the first and the last line.
    With ``as_of`` the spine ends with the period before it or around it, so missing
    data is found when all logs stop, and later lines are not looked at. In a period
    that is not over, too little or nothing is no breach yet; too much is.
    """
    if as_of is not None:
        logs = logs.where(F.col("ts") < F.lit(as_of).cast("timestamp_ntz"))
        # Seconds, rounded up.
        until = -((datetime(1970, 1, 1) - as_of) // timedelta(seconds=1))
    counts = metric_counters(logs)
    spark = logs.sparkSession
    ends = logs.agg(
        F.min(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("lo"),
        F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("hi"),
    )
    if as_of is not None:
        ends = ends.withColumn("hi", F.lit(until - 1).cast("bigint"))
    spine = (
        spark.range(1)
        .select(F.inline(_alarm_rows()))
        .withColumn("ends", ends.select(F.struct("lo", "hi")).scalar())
        .where("ends.lo is not null")
        .selectExpr(
            "*",
            "explode(sequence(ends.lo - ends.lo % period_s, ends.hi - ends.hi % period_s, period_s)) as w",
        )
        .drop("ends")
    )
    wanted = F.filter(_alarm_rows(), lambda a: a["metric"] == F.col("metric"))
    sums = (
        counts.select("w", "n", F.explode(wanted).alias("a"))
        .groupBy(F.col("a.alarm").alias("alarm"), (F.col("w") - F.col("w") % F.col("a.period_s")).alias("w"))
        .agg(F.sum("n").alias("n"))
    )
    breach = (
        F.when(F.col("n").isNull(), F.col("missing_breaches"))
        .when(F.col("below"), F.col("n") < F.col("threshold"))
        .otherwise(F.col("n") > F.col("threshold"))
    )
    if as_of is not None:
        early = (F.col("w") + F.col("period_s") > until) & (F.col("below") | F.col("n").isNull())
        breach = F.when(early, F.lit(False)).otherwise(breach)
    ordered = W.partitionBy("alarm").orderBy("w")
    # Each alarm looks back over as many periods as it asks for.
    widths = sorted({a.periods for a in config.ALARMS})
    recent = F.coalesce(*[F.when(F.col("periods") == n, F.sum("breach").over(ordered.rowsBetween(1 - n, 0))) for n in widths])
    return (
        spine.join(sums, ["alarm", "w"], "left")
        .withColumn("breach", breach.cast("int"))
        .withColumn("breaches", recent)
        .select(
            "alarm",
            as_time(F.col("w")).alias("window_start"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("value"),
            (F.col("breach") == 1).alias("breaching"),
            F.when(F.col("breaches") >= F.col("to_alarm"), F.lit("ALARM")).otherwise(F.lit("OK")).alias("state"),
        )
    )


def no_data_periods(measurements: DataFrame, periods: int = 2, as_of: datetime | None = None) -> DataFrame:
    """Hours in which a host has sent nothing for so many hours running.

    The silent hours lie between two neighbouring hours with data, so they are
    generated from the pair; no spine and no join. With ``as_of`` the hour it falls
    in ends the last gap of every host, so an outage that goes on is found too, and
    later records are not looked at.
    """
    hours = measurements.select("host_id", timeparts.hour_start(F.col("bucket_start")).alias("hour")).distinct()
    if as_of is not None:
        end = F.lit(as_of.replace(minute=0, second=0, microsecond=0)).cast("timestamp_ntz")
        hours = hours.where(F.col("hour").cast("timestamp_ntz") < end)
        hours = hours.union(hours.select("host_id", end.cast(hours.schema["hour"].dataType).alias("hour")).distinct())
    step = F.expr("interval 1 hour")
    before = F.lag("hour").over(W.partitionBy("host_id").orderBy("hour"))
    gaps = hours.withColumn("from", before + step * periods).where(F.col("from") < F.col("hour"))
    return gaps.select("host_id", F.explode(F.sequence("from", F.col("hour") - step, step)).alias("hour"))

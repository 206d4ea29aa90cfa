"""Roll-ups: measurements -> hourly and daily summaries -> weeks, months, years.

Hourly and daily summaries need exact order statistics and top-K values for each
host and for all hosts together, where the ``all`` group holds every row and one
host may hold a third of them. No group is ever gathered row by row:

1. each measurement becomes one entry per dimension (three metrics, server,
   connection type), and entries are *counted per distinct value* with a
   map-side combine. The shuffle key includes the value, so a hot host spreads
   over all tasks; ``all`` adds up the counts of the hosts, not the rows;
2. ranks are running sums of those counts, in a window that sees one row per
   distinct reading instead of one per measurement;
3. only the rows that hold a wanted rank go on to the last, small group-by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netpulse import config
from netpulse.functions import exact, timeparts
from netpulse.operators import anomaly
from netpulse.sources.normalize import is_valid

METRICS = {"download_mbps": "download_c", "upload_mbps": "upload_c", "ping_ms": "ping_c"}
PERCENTILES = {"p99": 0.99, "p95": 0.95, "p90": 0.90, "p50": 0.50}
# Dimensions of the value counts; codes keep the shuffled rows small.
DIMS = {name: code for code, name in enumerate((*METRICS, "server", "connection", "error"))}
SERVER, CONNECTION, ERROR = DIMS["server"], DIMS["connection"], DIMS["error"]


def with_all_hosts(df: DataFrame) -> DataFrame:
    """Each row once for its host and once for ``all``."""
    hosts = F.explode(F.array("host_id", F.lit(config.ALL_HOSTS)))
    return df.withColumn("host_id", hosts)


def entries(measurements: DataFrame, *columns: str | Column) -> DataFrame:
    """``host_id``, ``columns``, ``seq, dim, num, txt``: one row per dimension of a record."""

    def entry(dim: int, num: str = "bigint(null)", txt: str = "string(null)") -> str:
        return f"named_struct('dim', tinyint({dim}), 'num', {num}, 'txt', {txt})"

    metrics = [entry(DIMS[metric], num=c) for metric, c in METRICS.items()]
    texts = [entry(SERVER, txt="server_label"), entry(CONNECTION, txt="nullif(connection_type, '')")]
    error = entry(ERROR, num="bigint(1)")
    parts = F.when(is_valid(), F.expr(f"array({', '.join(metrics + texts)})")).otherwise(
        F.expr(f"array({error})")
    )
    narrow = measurements.select("host_id", *columns, "seq", F.explode(parts).alias("e"))
    return narrow.where(F.col("e.num").isNotNull() | F.col("e.txt").isNotNull()).select(
        "*", "e.dim", "e.num", "e.txt"
    ).drop("e")


def counted(rows: DataFrame, *group: str | Column) -> DataFrame:
    """Distinct values of ``entries`` with their number ``n`` and first arrival ``first_seq``."""
    return rows.groupBy(*group, "host_id", "dim", "num", "txt").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")
    )


def with_counts_of_all(per_host: DataFrame) -> DataFrame:
    """The counts of every host and those of ``all``, which add up the hosts' and not the rows."""
    value = ["period", "dim", "num", "txt"]
    per_host = per_host.select("host_id", *value, "n", "first_seq")
    # Both sides read the same exchange; the measurements are scanned once.
    of_all = (
        per_host.groupBy(F.lit(config.ALL_HOSTS).alias("host_id"), *value)
        .agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))
    )
    return per_host.unionByName(of_all)


def value_counts(measurements: DataFrame, level: str) -> DataFrame:
    """``host_id, period, dim, num, txt, n, first_seq``: distinct values of each group."""
    period = timeparts.period_of(F.col("bucket_start"), level).alias("period")
    return with_counts_of_all(counted(entries(measurements, period), "period"))


def floor_rank(p: float, count: str) -> str:
    """Zero-based position ``int(p * (count - 1))``, in double arithmetic."""
    return f"floor({p}D * ({count} - 1))"


# Zero-based ranks a summary needs.
RANKS = {
    "min": "0",
    "max": "total - 1",
    "mid_low": "(total - 1) div 2",
    "mid_high": "total div 2",
    **{name: floor_rank(p, "total") for name, p in PERCENTILES.items()},
}


def _holds(rank: str) -> str:
    """The distinct value of this row covers the rank."""
    return f"(upto - n <= {rank} and {rank} < upto)"


def _per_dimension(counts: DataFrame, servers: int, connections: int | None) -> DataFrame:
    """One row per host, period and dimension, in the partitioning of the ranking window."""
    group = W.partitionBy("host_id", "period", "dim")
    order = group.orderBy("num", F.desc("n"), "first_seq", "txt")
    ranked = counts.withColumns(
        {
            "rank": F.row_number().over(order),
            "upto": F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)),
            "total": F.sum("n").over(group),
        }
    )
    listed = f"(dim = {SERVER} and rank <= {servers})"
    listed += f" or (dim = {CONNECTION}" + (f" and rank <= {connections})" if connections else ")")
    return ranked.groupBy("host_id", "period", "dim").agg(
        F.expr("sum(n)").alias("n"),
        F.expr("sum(num * n)").alias("sum"),
        *[F.expr(f"max(case when {_holds(r)} then num end)").alias(name) for name, r in RANKS.items()],
        F.expr(f"sort_array(collect_list(case when {listed} then struct(rank, txt) end))").alias("items"),
    )


def summaries(measurements: DataFrame, level: str) -> DataFrame:
    """Hourly or daily summaries of each host and of ``all``."""
    return summaries_of(value_counts(measurements, level), level)


def summaries_of(counts: DataFrame, level: str) -> DataFrame:
    """Summaries from value counts.

    ``host_id, period, records, completion_rate, errors, overall, servers_top,
    connection_types, anomalies, threshold_mbps, connection_type_thresholds`` and
    the exact sums the report jobs use.
    """
    settings = config.LEVELS[level]
    hourly_level = level == "hourly"
    dims = _per_dimension(
        counts,
        settings.top_servers,
        None if hourly_level else config.TOP_CONNECTIONS,
    )
    numbers = "struct(n, sum, " + ", ".join(RANKS) + ")"
    wide = (
        dims.groupBy("host_id", "period")
        .agg(
            *[F.expr(f"max(case when dim = {DIMS[m]} then {numbers} end)").alias(m) for m in METRICS],
            F.expr(f"max(case when dim = {ERROR} then n end)").alias("errors"),
            F.expr(f"max(case when dim = {SERVER} then items.txt end)").alias("servers"),
            F.expr(f"max(case when dim = {CONNECTION} then items.txt end)").alias("connections"),
        )
        .where("download_mbps.n > 0")
    )
    types = F.coalesce("connections", F.array().cast("array<string>"))
    records = F.col("download_mbps.n")
    out = wide.select(
        "host_id",
        "period",
        records.alias("records"),
        exact.percent(records, F.lit(settings.expected)).alias("completion_rate"),
        F.coalesce("errors", F.lit(0)).cast("bigint").alias("errors"),
        F.struct(*[_stats(metric).alias(metric) for metric in METRICS]).alias("overall"),
        F.coalesce("servers", F.array().cast("array<string>")).alias("servers_top"),
        (F.sort_array(types) if hourly_level else types).alias("connection_types"),
        F.try_element_at(types, F.lit(1)).alias("top_connection"),
        *[F.col(f"{m}.{s}").alias(f"{m}_{s}") for m in METRICS for s in ("n", "sum", "min", "max")],
    )
    return anomaly.with_period_anomalies(out, level)


def completeness(measurements: DataFrame, level: str) -> DataFrame:
    """Records, errors and the two data warnings alone: one aggregation, nothing ranked."""
    settings = config.LEVELS[level]
    per_host = measurements.groupBy(
        "host_id", timeparts.period_of(F.col("bucket_start"), level).alias("period")
    ).agg(F.count_if(is_valid()).alias("records"), F.count_if(~is_valid()).alias("errors"))
    return (
        with_all_hosts(per_host)
        .groupBy("host_id", "period")
        .agg(F.sum("records").alias("records"), F.sum("errors").alias("errors"))
        .where("records > 0")
        .withColumns(anomaly.data_warnings(settings.expected))
    )


def _stats(metric: str) -> Column:
    def hundredth(name: str) -> Column:
        return exact.from_hundredths(F.col(f"{metric}.{name}"))

    middle = F.col(f"{metric}.mid_low") + F.col(f"{metric}.mid_high")
    mean = exact.mean_hundredths(F.col(f"{metric}.sum"), F.col(f"{metric}.n"))
    return F.struct(
        exact.from_hundredths(mean).alias("avg"),
        exact.from_hundredths(exact.div_half_up(middle, F.lit(2).cast("bigint"))).alias("median"),
        *[hundredth(name).alias(name) for name in ("max", "min", *PERCENTILES)],
    )


def hourly(measurements: DataFrame) -> DataFrame:
    return summaries(measurements, "hourly")


def daily(measurements: DataFrame) -> DataFrame:
    return summaries(measurements, "daily")


def period_means(measurements: DataFrame, level: str) -> DataFrame:
    """``host_id, period, records`` and the means of hours or days, straight from measurements.

    The same means as in the summaries without their ranks and lists: sums and counts combine map-side, and those of
    ``all`` are added up from one row per host and period.
    """
    columns = {"avg_download": "download_c", "avg_upload": "upload_c", "avg_ping": "ping_c"}
    sums = [F.sum(c).alias(c) for c in columns.values()] + [F.count(c).alias(f"{c}_n") for c in columns.values()]
    hosts = (
        measurements.where(is_valid())
        .groupBy("host_id", timeparts.period_of(F.col("bucket_start"), level).alias("period"))
        .agg(F.count(F.lit(1)).alias("records"), *sums)
    )
    added = ["records", *columns.values(), *[f"{c}_n" for c in columns.values()]]
    totals = with_all_hosts(hosts).groupBy("host_id", "period").agg(*[F.sum(c).alias(c) for c in added])
    means = [exact.from_hundredths(exact.mean_hundredths(F.col(c), F.col(f"{c}_n"))).alias(name) for name, c in columns.items()]
    return totals.select("host_id", "period", "records", *means)


def as_period_means(daily_summaries: DataFrame, *others: str) -> DataFrame:
    """Daily summaries reduced to what coarser levels read, and ``others``."""
    return daily_summaries.select(
        "host_id",
        "period",
        F.col("overall.download_mbps.avg").alias("avg_download"),
        F.col("overall.upload_mbps.avg").alias("avg_upload"),
        F.col("overall.ping_ms.avg").alias("avg_ping"),
        "connection_types",
        *others,
    )


COUNT_NAME = {"weekly": "days", "monthly": "days", "yearly": "months_aggregated"}


def coarser(means: DataFrame, level: str) -> DataFrame:
    """Weeks and months from days, years from months: plain means of rounded means.

    Inputs hold one row per host and period, so the lists gathered here have at
    most 31 short members. Means without connection types give means without them.
    """

    def mean(c: str) -> Column:
        total = F.sum(exact.hundredths(F.col(c)))
        return exact.from_hundredths(exact.mean_hundredths(total, F.count(c))).alias(c)

    types = F.sort_array(F.array_distinct(F.flatten(F.collect_list("connection_types")))).alias("connection_types")
    return (
        means.withColumn("period", timeparts.period_of(F.col("period").cast("timestamp_ntz"), level))
        .groupBy("host_id", "period")
        .agg(
            F.count(F.lit(1)).alias(COUNT_NAME[level]),
            mean("avg_download"),
            mean("avg_upload"),
            mean("avg_ping"),
            *([types] if "connection_types" in means.columns else []),
        )
    )


def weekly(daily_summaries: DataFrame) -> DataFrame:
    weeks = coarser(as_period_means(daily_summaries), "weekly")
    return weeks.withColumn("week_end", F.date_add("period", 6))


def monthly(daily_summaries: DataFrame) -> DataFrame:
    return coarser(as_period_means(daily_summaries), "monthly")


def yearly(monthly_summaries: DataFrame) -> DataFrame:
    return coarser(monthly_summaries, "yearly")


def members(measurements: DataFrame, level: str) -> DataFrame:
    """The lists of a summary in long form: one row per member.

    ``kind`` is ``host``, ``ip``, ``connection`` or ``url``. At scale the URL list
    of ``all`` is as long as the table itself, so members stay rows; ``first_seq``
    gives the order of URLs, the other kinds sort by ``item``.
    """
    items = F.array(
        F.struct(F.lit("host").alias("kind"), F.col("host_id").alias("item")),
        F.struct(F.lit("ip").alias("kind"), F.nullif("public_ip", F.lit("")).alias("item")),
        F.struct(
            F.lit("connection").alias("kind"), F.nullif("connection_type", F.lit("")).alias("item")
        ),
        F.struct(
            F.lit("url").alias("kind"),
            F.when(F.startswith("result_url", F.lit("http")), F.col("result_url")).alias("item"),
        ),
    )
    narrow = (
        measurements.where(is_valid())
        .select(
            "host_id",
            timeparts.period_of(F.col("bucket_start"), level).alias("period"),
            "seq",
            F.inline(items),
        )
        .where(F.col("item").isNotNull())
    )
    return (
        with_all_hosts(narrow)
        .groupBy("host_id", "period", "kind", "item")
        .agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    )


def run_report(daily_summaries: DataFrame) -> DataFrame:
    """Per day: hosts aggregated, their records, and the records of ``all``."""
    of_all = F.col("host_id") == config.ALL_HOSTS
    return daily_summaries.groupBy("period").agg(
        F.count_if(~of_all).alias("hosts_aggregated"),
        F.sum(F.when(~of_all, F.col("records"))).alias("host_records"),
        F.sum(F.when(of_all, F.col("records"))).alias("total_records"),
        F.sum(F.when(of_all, F.size("anomalies"))).cast("bigint").alias("anomalies"),
    )

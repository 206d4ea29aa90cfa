"""Statistics over view rows: summary, percentiles, trends, records, facets, addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netpulse import config
from netpulse.functions import exact, text, timeparts
from netpulse.operators import ordinal
from netpulse.session import shared_folder

METRICS = ("download", "upload", "ping")


def _c(metric: str) -> Column:
    return exact.hundredths(F.col(f"{metric}_avg"))


def summary_stats(view: DataFrame) -> DataFrame:
    """One row: the three means, rows, rows below expectation and the most frequent server."""
    servers = view.groupBy("top_server").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("below_expected").alias("below"),
        *[F.sum(_c(m)).alias(f"{m}_sum") for m in METRICS],
        *[F.count(_c(m)).alias(f"{m}_n") for m in METRICS],
    )

    def mean(m: str) -> Column:
        return exact.from_hundredths(exact.mean_hundredths(F.sum(f"{m}_sum"), F.sum(f"{m}_n")))

    # Most frequent, then smallest text: a minimum over the servers, not a sort.
    best = F.min(F.when(F.col("top_server").isNotNull(), F.struct(-F.col("n"), "top_server")))
    return servers.agg(
        *[mean(m).alias(f"avg_{m}") for m in METRICS],
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_tests"),
        F.coalesce(F.sum("below"), F.lit(0)).cast("bigint").alias("below_expected"),
        F.coalesce(best["top_server"], F.lit("N/A")).alias("top_server_over_period"),
    )


def below_expected_periods(view: DataFrame) -> DataFrame:
    """Periods with any row below expectation, and periods in all."""
    days = view.groupBy("date_ist").agg(F.bool_or("below_expected").alias("any_below"))
    return days.agg(
        F.count_if("any_below").alias("below_expected"), F.count(F.lit(1)).alias("total_days")
    )


def linear_percentiles(view: DataFrame) -> DataFrame:
    """p50, p95 and p99 of each metric with linear interpolation.

    ``percentile`` combines map-side and holds one entry per distinct reading.
    Interpolation runs on hundredths, rounded in two steps so that a half is a
    half whatever the last bits say.
    """
    points = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    wanted = F.array(*[F.lit(p) for p in points.values()])
    raw = view.agg(*[F.percentile(_c(m), wanted).alias(m) for m in METRICS])
    return raw.select(
        *[
            rounded_hundredths(F.get(m, F.lit(i))).alias(f"{m}_{name}")
            for m in METRICS
            for i, name in enumerate(points)
        ]
    )


def rounded_hundredths(value: Column) -> Column:
    """A fractional number of hundredths -> two decimals, halves up."""
    return exact.from_hundredths(F.round(value.cast("decimal(28,6)"), 0))


def approximate_percentiles(view: DataFrame, accuracy: int = 10000) -> DataFrame:
    """The same points from a bounded sketch, for readings without two decimals."""
    wanted = F.array(F.lit(0.50), F.lit(0.95), F.lit(0.99))
    raw = view.agg(*[F.approx_percentile(f"{m}_avg", wanted, accuracy).alias(m) for m in METRICS])
    return raw.select(
        *[
            F.get(m, F.lit(i)).alias(f"{m}_{name}")
            for m in METRICS
            for i, name in enumerate(("p50", "p95", "p99"))
        ]
    )


def trend_halves(view: DataFrame, tie_break: list[str]) -> DataFrame:
    """Change of the means between the earlier and the later half of the rows, in percent.

    Rows are first summed per hour. Hours lie wholly in one half but for the one that
    holds the middle; only the rows of that hour are put in order.
    """
    shared_folder(view.sparkSession)
    half = F.call_function("div", F.col("n_all"), F.lit(2))
    hour = timeparts.hour_start(F.col("date_ist").cast("timestamp_ntz"))
    narrow = view.select(hour.alias("hour"), "date_ist", *tie_break, *[_c(m).alias(m) for m in METRICS])
    per_hour = narrow.groupBy("hour").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(m).alias(m) for m in METRICS],
        *[F.count(m).alias(f"{m}_n") for m in METRICS],
    )
    # One row per hour of the calendar: small enough for a running sum in one task.
    in_order = W.orderBy("hour")
    hours = (
        per_hour.withColumns(
            {
                "before": F.coalesce(F.sum("rows").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
                "n_all": F.sum("rows").over(W.partitionBy()),
            }
        )
        .withColumn("middle", (F.col("before") < half) & (half < F.col("before") + F.col("rows")))
        .checkpoint(eager=True)
    )
    middle = hours.where("middle").select("hour", "before", "n_all")
    inside = narrow.where(F.col("hour") == middle.agg(F.max("hour")).scalar())
    placed = ordinal.with_position(inside, [], ["date_ist", *tie_break]).join(middle, "hour")
    whole = hours.where(~F.col("middle")).select(
        (F.col("before") >= half).alias("later"), "rows", *METRICS, *[f"{m}_n" for m in METRICS]
    )
    split = placed.select(
        (F.col("before") + F.col("pos") >= half).alias("later"),
        F.lit(1).cast("bigint").alias("rows"),
        *METRICS,
        *[F.col(m).isNotNull().cast("bigint").alias(f"{m}_n") for m in METRICS],
    )

    def of(part: bool, c: str) -> Column:
        return F.sum(F.when(F.col("later") == part, F.col(c)))

    sums = whole.unionByName(split).agg(
        of(True, "rows").alias("n_now"),
        of(False, "rows").alias("n_before"),
        *[of(True, c).alias(f"{c}_now") for m in METRICS for c in (m, f"{m}_n")],
        *[of(False, c).alias(f"{c}_before") for m in METRICS for c in (m, f"{m}_n")],
    ).where("n_now + n_before > 1")

    def wide(c: Column) -> Column:
        return c.cast(exact.WIDE)

    def change(now: Column, n_now: Column, before: Column, n_before: Column) -> Column:
        base = wide(before) * wide(n_now)
        moved = (wide(now) * wide(n_before) - base) * 1000
        tenths = exact.div_half_up(moved, base)
        return F.coalesce(tenths.cast("double"), F.lit(0.0)) / 10.0

    def of_metric(m: str) -> Column:
        parts = (f"{m}_now", f"{m}_n_now", f"{m}_before", f"{m}_n_before")
        return change(*[F.col(c) for c in parts]).alias(f"{m}_change")

    return sums.select(
        *[of_metric(m) for m in METRICS],
        change(F.col("n_now"), F.lit(1), F.col("n_before"), F.lit(1)).alias("tests_change"),
    )


def historical_records(view: DataFrame) -> DataFrame:
    """Best and worst rows, the earliest on ties: ``record, value, date_ist, server``."""

    def row(metric: str, sign: int) -> Column:
        key = F.struct((_c(metric) * sign).alias("k"), F.col("date_ist"))
        data = F.struct(F.col(f"{metric}_avg").alias("value"), "date_ist", "top_server")
        return F.min(F.when(_c(metric).isNotNull(), F.struct(key.alias("key"), data.alias("data"))))

    wanted = {
        "best_download": ("download", -1),
        "worst_download": ("download", 1),
        "best_upload": ("upload", -1),
        "lowest_ping": ("ping", 1),
    }
    found = view.agg(*[row(m, sign).alias(name) for name, (m, sign) in wanted.items()])
    rows = F.array(
        *[F.struct(F.lit(name).alias("record"), F.col(f"{name}.data").alias("d")) for name in wanted]
    )
    return (
        found.select(F.inline(rows))
        .where(F.col("d").isNotNull())
        .select(
            "record",
            "d.value",
            "d.date_ist",
            F.when(F.col("record") == "best_download", F.col("d.top_server")).alias("server"),
        )
    )


def connection_stats(view: DataFrame) -> DataFrame:
    """Per listed connection type contained in a row's types: count, mean and share below the minimum."""
    types = F.lower("connection_type")
    matched = F.array_compact(
        F.array(
            *[
                F.when(
                    types.contains(name.lower()),
                    F.struct(
                        F.lit(name).alias("connection"),
                        F.lit(limit).alias("threshold"),
                        F.lit(minimum).alias("min_threshold"),
                    ),
                )
                for name, (limit, minimum) in config.CONNECTION_LIMITS.items()
            ]
        )
    )
    below = F.count_if(F.col("c") < F.col("min_threshold") * 100)
    return (
        view.select(_c("download").alias("c"), F.inline(matched))
        .groupBy("connection", "threshold", "min_threshold")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum("c").alias("total"),
            F.count("c").alias("known"),
            below.alias("below_min"),
        )
        .select(
            "connection",
            "count",
            (exact.div_half_up(F.col("total"), F.col("known") * 10).cast("double") / 10.0).alias("avg"),
            "threshold",
            "min_threshold",
            "below_min",
            exact.percent(F.col("below_min"), F.col("count")).alias("below_pct"),
        )
    )


def connection_facets(view: DataFrame) -> DataFrame:
    """How many rows contain each connection type, without the unknown band.

    Rows first collapse to distinct type lists. Their substrings, of those lengths
    that names have, meet the names by equality: the work grows with the text of the
    lists and not with lists times names. Only the lengths are read as one scalar.
    """
    lists = view.groupBy("connection_type").agg(F.count(F.lit(1)).alias("n")).where("connection_type IS NOT NULL")
    parts = F.transform(F.split("connection_type", ","), lambda x: F.trim(x))
    named = (F.col("name") != "") & (F.col("name") != config.UNKNOWN_BAND)
    names = lists.select(F.explode(parts).alias("name")).where(named).distinct().withColumn("key", F.lower("name"))
    sizes = names.agg(F.collect_set(F.length("key")))
    text_ = F.lower("connection_type")
    places = lists.select("connection_type", "n", text_.alias("text"), sizes.scalar().alias("sizes"))
    places = places.select("*", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at")).where("text <> ''")
    pieces = places.select("connection_type", "n", "text", "at", F.explode("sizes").alias("size"))
    pieces = pieces.where("at + size - 1 <= length(text)").select("connection_type", "n", F.substr("text", "at", "size").alias("key"))
    return (
        pieces.join(names, "key")
        .groupBy("connection_type", "name")
        .agg(F.first("n").alias("n"))
        .groupBy("name")
        .agg(F.sum("n").alias("count"))
    )


def isp_facets(view: DataFrame) -> DataFrame:
    return (
        view.where(F.col("host_isp") != "")
        .groupBy(F.col("host_isp").alias("name"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def quick_filter_counts(view: DataFrame) -> DataFrame:
    return view.agg(
        F.count_if(_c("download") < 20000).alias("below_threshold"),
        F.count_if(_c("download") < 10000).alias("performance_drops"),
        F.count_if(_c("ping") > 2000).alias("high_ping"),
    )


def cidr_groups(addresses: DataFrame) -> DataFrame:
    """Known addresses by network: a /16 with three or more /24 blocks is one group.

    ``addresses`` has a ``public_ip`` column. IPv6 addresses are grouped by their first
    16 and 24 bits likewise; spellings of one address count one by one. What is no
    address of either kind is in no group.
    """
    ip = F.trim("public_ip")
    known = addresses.where(text.is_known_ip(F.col("public_ip"))).select(ip.alias("ip")).distinct()
    told = known.select("ip", F.col("ip").rlike(text.IPV4).alias("v4"), text.ipv6_groups(F.col("ip")).alias("v6"))
    blocks = (
        told.where(F.col("v4") | F.col("v6").isNotNull())
        .groupBy(
            F.when(F.col("v4"), text.cidr16(F.col("ip"))).otherwise(text.ipv6_cidr16(F.col("v6"))).alias("net16"),
            F.when(F.col("v4"), text.cidr24(F.col("ip"))).otherwise(text.ipv6_cidr24(F.col("v6"))).alias("net24"),
        )
        .agg(F.count(F.lit(1)).alias("ips"))
    )
    # At most 256 blocks of a /16 meet in the second step.
    nets = blocks.groupBy("net16").agg(
        F.sum("ips").alias("ips"),
        F.collect_list(F.struct(F.col("net24").alias("cidr"), F.col("ips").alias("count"))).alias("blocks"),
    )
    whole = F.array(F.struct(F.col("net16").alias("cidr"), F.col("ips").alias("count")))
    return nets.select(F.inline(F.when(F.size("blocks") >= 3, whole).otherwise(F.col("blocks"))))


# Speed bands in Mbps, from and below.
BANDS = {
    "1: < 100": (None, 100),
    "2: 100-150": (100, 150),
    "3: 150-180": (150, 180),
    "4: 180-200": (180, 200),
    "5: >= 200": (200, None),
}


def speed_distribution(view: DataFrame) -> DataFrame:
    """Speed bands with their share, and the quartiles repeated on each row: one aggregation."""
    c = _c("download")

    def inside(low: int | None, high: int | None) -> Column:
        test = c.isNotNull()
        if low is not None:
            test = test & (c >= low * 100)
        return test if high is None else test & (c < high * 100)

    whole = view.agg(
        F.count(c).alias("n"),
        F.sum(c).alias("total"),
        F.min(c).alias("low"),
        F.max(c).alias("high"),
        F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.array(
            *[
                F.struct(F.lit(name).alias("band"), F.count_if(inside(*limits)).alias("tests"))
                for name, limits in BANDS.items()
            ]
        ).alias("bands"),
    )
    return (
        whole.select("*", F.inline("bands"))
        .where("tests > 0")
        .select(
            "band",
            "tests",
            exact.percent(F.col("tests"), F.col("n")).alias("share"),
            exact.from_hundredths(exact.mean_hundredths(F.col("total"), F.col("n"))).alias("mean"),
            *[rounded_hundredths(F.get("q", F.lit(i))).alias(p) for i, p in enumerate(("p25", "p50", "p75"))],
            exact.from_hundredths(F.col("low")).alias("min"),
            exact.from_hundredths(F.col("high")).alias("max"),
        )
    )

"""Writers: summary tables, landed records, manifests, new versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpulse.config import ALL_HOSTS
from netpulse.functions import timeparts
from netpulse.operators import quality
from netpulse.session import fresh_folder

# One partition per period: a run of one period replaces that period and nothing else.
PARTITIONS = {
    "hourly": ["year", "month", "day", "hour"],
    "daily": ["year", "month", "day"],
    "weekly": ["year", "week"],
    "monthly": ["year", "month"],
    "yearly": ["year"],
}
_PARTS = {"year": "yyyy", "month": "yyyyMM", "day": "yyyyMMdd", "hour": "yyyyMMddHH", "minute": "yyyyMMddHHmm"}


def _path_parts(start: Column, names: list[str]) -> dict[str, Column]:
    return {
        name: timeparts.iso_week_label(start) if name == "week" else F.date_format(start, _PARTS[name])
        for name in names
    }


def write_summaries(summaries: DataFrame, level: str, path: str) -> None:
    """Replace the partitions this run produced and leave the others alone.

    A repeated run of a period gives the same table. Rows of a partition meet in
    few files (``rebalance`` splits a large one); hosts are not partitions, or a
    table of many hosts would be all directories.
    """
    names = PARTITIONS[level]
    rows = summaries.withColumns(_path_parts(F.col("period"), names)).hint("rebalance", *names)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*names)
        .parquet(path)
    )


def read_summaries(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def written(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """The frame as a table in the shared folder, read back; ``options`` are the writer's.

    For results several jobs read: without it each reader would run the whole
    chain from the raw table again. A lost executor costs nothing afterwards.
    """
    spark = df.sparkSession
    folder = fresh_folder(spark, purpose)
    df.write.options(**options).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def write_members(members: DataFrame, path: str) -> None:
    """The lists of summaries as rows, by kind; whole at every size.

    A list of ``all`` is as long as the raw table, so it is never gathered.
    """
    members.hint("rebalance", "kind").write.mode("overwrite").partitionBy("kind").parquet(path)


# What a summary carries for other jobs and its document does not show.
_INTERNAL = [
    "low_data",
    "high_errors",
    "top_connection",
    *[f"{m}_{s}" for m in ("download_mbps", "upload_mbps", "ping_ms") for s in ("n", "sum", "min", "max")],
]


def _period_fields(level: str) -> dict[str, Column]:
    """The fields that name the period in a document of the level."""
    start = F.col("period")
    return {
        "hourly": {"hour_ist": timeparts.period_label(start, "hourly")},
        "daily": {"date_ist": timeparts.period_label(start, "daily")},
        "weekly": {
            "week_start": F.date_format(start, "yyyy-MM-dd"),
            "week_end": F.date_format(F.date_add(start, 6), "yyyy-MM-dd"),
        },
        "monthly": {"month": F.date_format(start, _PARTS["month"])},
        "yearly": {"year": F.year(start)},
    }[level]


def as_documents(summaries: DataFrame, level: str, thresholds: bool = True) -> DataFrame:
    """Summaries as JSON text, for export beside the table. Fields without a value stay, as null."""
    drop = list(_INTERNAL)
    if not thresholds:
        drop.append("connection_type_thresholds")
    body = summaries.drop(*drop).withColumns(_period_fields(level))
    doc = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return body.select("host_id", "period", doc.alias("doc"))


def export_documents(docs: DataFrame, level: str, root: str) -> None:
    """``host_id, period, doc`` as text below ``root``, one document a line, in the folders of the level.

    ``root`` belongs to this level alone: replacing a month would take the days below it along.
    Rows of all hosts together go to ``year=…/…``, those of one host to ``host=…/year=…/…``.
    A repeated run replaces the periods it produced.
    """
    rows = docs.withColumns(_path_parts(F.col("period"), PARTITIONS[level]))
    for own in (False, True):
        names = ["host", *PARTITIONS[level]] if own else PARTITIONS[level]
        part = rows.where((F.col("host_id") != ALL_HOSTS) if own else (F.col("host_id") == ALL_HOSTS))
        if own:
            part = part.withColumn("host", F.col("host_id"))
        (
            part.select("doc", *names)
            .hint("rebalance", *names)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*names)
            .text(root)
        )


def land_raw(raw: DataFrame, path: str, depth: list[str], legacy: bool = False, mode: str = "append") -> None:
    """Raw records as JSON under ``host=…/year=…/…``, or without host for legacy ones.

    ``raw`` carries ``host_id`` and ``bucket_start``.
    """
    parts = _path_parts(F.col("bucket_start"), depth)
    rows = raw.withColumns(parts)
    names = list(depth)
    if legacy:
        rows = rows.drop("host_id")
    else:
        rows = rows.withColumn("host", F.col("host_id"))
        names = ["host", *names]
    rows.drop("bucket_start").hint("rebalance", *names).write.mode(mode).partitionBy(*names).json(path)


def with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.date_format("bucket_start", "yyyyMMdd").cast("int"))


def land_new(incoming: DataFrame, landed: DataFrame, path: str) -> None:
    """Append the first record of each host and bucket that is not there yet.

    ``landed`` is the table at ``path`` (partitioned by ``day``), or an empty frame of
    its schema. Only the days the incoming rows touch are read from it.
    """
    incoming = with_day(incoming).persist()
    try:
        days = incoming.select("day").distinct()
        touched = landed.join(days, "day", "left_semi")
        fresh = quality.insert_if_absent(incoming, touched, ["host_id", "bucket_start"], ["ts", "seq"])
        fresh.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)
    finally:
        incoming.unpersist()


def append_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("append").parquet(path)


def write_manifest_run(manifest: DataFrame, path: str) -> None:
    """Entries of a run, by run and type: a run that is repeated after a failure replaces its own and adds none twice."""
    rows = manifest.withColumn("run", F.date_format("timestamp", "yyyyMMddHHmmss"))
    (
        rows.hint("rebalance", "run", "type")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "type")
        .parquet(path)
    )


def manifest_documents(manifest: DataFrame, per_document: int = 1000) -> DataFrame:
    """Manifest entries as documents ``timestamp, files_created, files`` of about ``per_document`` files each.

    A run may produce any number of files, so its entries are dealt by their key over as many documents as that takes.
    """
    runs = manifest.groupBy("timestamp").agg(F.ceil(F.count(F.lit(1)) / per_document).alias("_documents"))
    dealt = manifest.join(runs, "timestamp").withColumn("_at", F.pmod(F.xxhash64("type", "key"), F.col("_documents")))
    files = F.collect_list(F.struct("bucket", "key", "type")).alias("files")
    return dealt.groupBy("timestamp", "_at").agg(F.count(F.lit(1)).alias("files_created"), files).select(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "files_created", "files"
    )


def write_version(rows: DataFrame, path: str, partitions: list[str]) -> None:
    """A new version of a table in a folder of its own.

    Dynamic overwrite never drops a partition that receives no rows, so deletions
    write what remains instead; a reader then moves to the new folder.
    """
    rows.hint("rebalance", *partitions).write.mode("errorifexists").partitionBy(*partitions).parquet(path)


def compact(raw: DataFrame, path: str) -> None:
    """Many small record files -> parquet by month, sorted by host for pruning inside files."""
    rows = raw.withColumn("month", F.date_format("bucket_start", "yyyyMM"))
    (
        rows.repartitionByRange("month", "host_id", "bucket_start")
        .sortWithinPartitions("month", "host_id", "bucket_start")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(path)
    )

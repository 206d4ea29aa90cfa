"""Raw records, inventories, manifests and summaries from files.

Raw records come in two layouts: ``host=H/year=…`` and, older, ``year=…``. One
read cannot hold both (their partition columns conflict), so each is read on its
own and the two are united. Partition values are numbers, and filters on them
prune directories before a file is opened.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netpulse.config import LEGACY_HOST
from netpulse.schemas import MANIFEST, RAW_MEASUREMENT

CORRUPT = "_corrupt_record"
PATH_FIELDS = {"year": T.IntegerType(), "month": T.IntegerType(), "day": T.IntegerType(),
               "hour": T.LongType(), "minute": T.LongType()}

PATH_FORMATS = {"year": "yyyy", "month": "yyyyMM", "day": "yyyyMMdd", "hour": "yyyyMMddHH", "minute": "yyyyMMddHHmm"}


def _layout(
    spark: SparkSession,
    root: str,
    pattern: str,
    host: bool,
    depth: tuple[str, ...],
    multiline: bool,
    modified_after: datetime | None,
    name_pattern: str,
) -> DataFrame | None:
    """Records of one layout, or None where no folder has it."""
    fields = list(RAW_MEASUREMENT.fields) + [T.StructField(CORRUPT, T.StringType())]
    if host:
        fields.append(T.StructField("host", T.StringType()))
    fields += [T.StructField(name, PATH_FIELDS[name]) for name in depth]
    reader = (
        spark.read.schema(T.StructType(fields))
        .option("basePath", root)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("pathGlobFilter", name_pattern)
    )
    if multiline:
        reader = reader.option("multiLine", "true")
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after.isoformat(timespec="microseconds"))
    try:
        df = reader.json(f"{root}/{pattern}")
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return df.withColumns(
        {
            "path": F.col("_metadata.file_path"),
            "modified": F.col("_metadata.file_modification_time"),
        }
    )


def read_raw(
    spark: SparkSession,
    root: str,
    *,
    host_layout: bool = True,
    legacy_layout: bool = True,
    depth: tuple[str, ...] = ("year", "month", "day", "hour", "minute"),
    multiline: bool = True,
    modified_after: datetime | None = None,
    name_pattern: str = "*.json",
) -> DataFrame:
    """Raw records of both layouts; unreadable ones are kept with ``corrupt`` set.

    ``depth`` names the path levels below the host. ``bucket_start`` comes from the
    path when it reaches the minute; ``path_start`` is the start of the deepest level.
    ``modified_after`` (session time zone) reads newer files only. A root may hold one layout or both;
    one that holds neither is an error.
    """
    parts = []
    if host_layout:
        parts.append(_layout(spark, root, "host=*", True, depth, multiline, modified_after, name_pattern))
    if legacy_layout:
        parts.append(_layout(spark, root, "year=*", False, depth, multiline, modified_after, name_pattern))
    parts = [part for part in parts if part is not None]
    if not parts:
        raise FileNotFoundError(f"no raw records below {root}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    if "host" not in out.columns:
        out = out.withColumn("host", F.lit(None).cast("string"))
    out = out.withColumns(
        {
            "host": F.coalesce("host", "host_id", F.lit(LEGACY_HOST)),
            "corrupt": F.col(CORRUPT).isNotNull(),
        }
    ).drop(CORRUPT)
    deepest = F.col(depth[-1]).cast("string")
    start = F.try_to_timestamp(deepest, F.lit(PATH_FORMATS[depth[-1]])).cast("timestamp_ntz")
    out = out.withColumn("path_start", start)
    return out.withColumn("bucket_start", start) if depth[-1] == "minute" else out


def for_days(raw: DataFrame, first: int, last: int) -> DataFrame:
    """Records of days ``YYYYMMDD``..``YYYYMMDD``: a condition on the path, before any read."""
    months = (F.col("month") >= first // 100) & (F.col("month") <= last // 100)
    years = (F.col("year") >= first // 10000) & (F.col("year") <= last // 10000)
    return raw.where(years & months & (F.col("day") >= first) & (F.col("day") <= last))


# --- inventory --------------------------------------------------------------

# What a key of a level contains, and must not contain.
KEY_PATTERNS = {
    "minutes": (r"minute=[0-9]+", ()),
    "hourly": (r"hour=[0-9]+", ("minute=",)),
    "daily": (r"day=[0-9]+", ("hour=",)),
    "weekly": (r"week=[0-9]+W[0-9]+", ()),
    "monthly": (r"month=[0-9]+", ("day=", "week=")),
    "yearly": (r"year=[0-9]{4}(?:/|$)", ("month=", "week=")),
}


def is_level(path: Column, level: str) -> Column:
    pattern, excluded = KEY_PATTERNS[level]
    test = path.rlike(pattern)
    for text in excluded:
        test = test & ~path.contains(text)
    return test


def inventory(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """One row per file below ``root``: ``path, modified, size``; contents are not read."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
    )
    return listed.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def newest(files: DataFrame) -> datetime | None:
    """When the newest file of an ``inventory`` was written, for the next ``modified_after``; None without files."""
    text = F.date_format(F.max("modified"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    found = files.select(text.alias("newest")).first()["newest"]
    return datetime.fromisoformat(found) if found else None


def host_of(path: Column) -> Column:
    found = F.nullif(F.regexp_extract(path, r"host=([^/]+)/", 1), F.lit(""))
    return F.coalesce(found, F.lit(LEGACY_HOST))


def period_key(path: Column, level: str) -> Column:
    """Label of the period a key belongs to, ``Unknown`` when it does not parse.

    Hours are accepted as ten digits, or as two digits below their day.
    """

    def digits(name: str, n: int) -> Column:
        return F.nullif(F.regexp_extract(path, rf"{name}=([0-9]{{{n}}})(?:/|$)", 1), F.lit(""))

    def formatted(text: Column, pattern: str, shown: str) -> Column:
        return F.date_format(F.try_to_timestamp(text, F.lit(pattern)), shown)

    if level == "minutes":
        label = formatted(digits("minute", 12), "yyyyMMddHHmm", "yyyy-MM-dd HH:mm")
    elif level == "hourly":
        short = F.concat(digits("day", 8), digits("hour", 2))
        label = formatted(F.coalesce(digits("hour", 10), short), "yyyyMMddHH", "yyyy-MM-dd HH:00")
    elif level == "daily":
        label = formatted(digits("day", 8), "yyyyMMdd", "yyyy-MM-dd")
    elif level == "weekly":
        year = F.nullif(F.regexp_extract(path, r"week=([0-9]{4})W[0-9]{1,2}", 1), F.lit(""))
        week = F.regexp_extract(path, r"week=[0-9]{4}W([0-9]{1,2})", 1)
        label = F.concat(year, F.lit("-W"), F.lpad(week, 2, "0"))
    elif level == "monthly":
        label = formatted(digits("month", 6), "yyyyMM", "yyyy-MM")
    else:
        label = digits("year", 4)
    return F.coalesce(label, F.lit("Unknown"))


def keyed_inventory(files: DataFrame) -> DataFrame:
    """``inventory`` with ``level``, ``host_id`` and ``period_key``, for the duplicate jobs."""
    path = F.col("path")
    level, key = F.lit(None).cast("string"), F.lit("Unknown")
    for name in reversed(list(KEY_PATTERNS)):
        level = F.when(is_level(path, name), F.lit(name)).otherwise(level)
        key = F.when(is_level(path, name), period_key(path, name)).otherwise(key)
    return files.withColumns({"level": level, "host_id": host_of(path), "period_key": key})


# --- documents, manifests ---------------------------------------------------


def documents(spark: SparkSession, root: str, pattern: str = "*.json", whole: bool = True) -> DataFrame:
    """Summary documents as text: ``key, doc``; one row per file, or per line where not ``whole``."""
    text = (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .text(root, wholetext=whole)
    )
    return text.select(F.col("_metadata.file_path").alias("key"), F.col("value").alias("doc"))


def manifest(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Manifest entries: ``timestamp, bucket, key, type``; one document per file, or per line where not ``multiline``."""
    df = spark.read.schema(MANIFEST).option("multiLine", str(multiline).lower()).json(path)
    return df.select("timestamp", F.inline("files"))


def drifted_means(docs: DataFrame) -> DataFrame:
    """Means and sample count of summary documents under any of their historical names."""
    v = F.try_parse_json("doc")

    def first_of(*paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get("v", f"$.{p}", "double") for p in paths])

    parsed = docs.withColumn("v", v)
    means = {
        f"avg_{short}": first_of(
            f"overall.{long}.avg", f"overall.avg_{long}", f"avg_{short}", f"avg_{long}", long
        )
        for short, long in (("download", "download_mbps"), ("upload", "upload_mbps"), ("ping", "ping_ms"))
    }
    count = F.coalesce(
        *[F.try_variant_get("v", f"$.{p}", "bigint") for p in ("days", "records", "count", "sample_count")]
    )
    ips = F.coalesce(
        F.try_variant_get("v", "$.public_ips", "array<string>"),
        F.array_compact(F.array(F.nullif(F.try_variant_get("v", "$.public_ip", "string"), F.lit("")))),
    )
    host = F.coalesce(F.try_variant_get("v", "$.host_id", "string"), F.lit(LEGACY_HOST))
    return parsed.withColumns({**means, "samples": count, "public_ips": ips, "host_id": host}).drop("v", "doc")

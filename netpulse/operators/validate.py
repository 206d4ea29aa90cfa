"""Structural validation of summary documents held as JSON text.

Documents are parsed as VARIANT, so a field of the wrong type is seen as what it
is. Every rule is a column expression; a document yields two arrays of messages.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Required fields and their kinds, statistics, and limits per level.
MEANS = {"avg_download": "number", "avg_upload": "number", "avg_ping": "number"}


@dataclass(frozen=True)
class Rules:
    required: dict[str, str]
    stats: tuple[str, ...] = ()
    missing_stat_is_error: bool = True
    date_fields: tuple[str, ...] = ()
    date_hint: str = ""
    count_field: str = ""
    count_max: int = 0
    count_over: str = ""  # message of a count above the maximum
    count_over_is_error: bool = True
    ranges: dict[str, tuple[int, int]] = field(default_factory=dict)


RULES = {
    "hourly": Rules(
        required={"hour_ist": "string", "records": "int", "overall": "object"},
        stats=("avg", "max", "min"),
        count_field="records",
        count_max=4,
        count_over="records=%s exceeds expected 4 per hour",
        count_over_is_error=False,
        ranges={"overall.download_mbps.avg": (0, 2000)},
    ),
    "daily": Rules(
        required={"date_ist": "string", "records": "int", "overall": "object"},
        stats=("avg", "max", "median", "min"),
        missing_stat_is_error=False,
        date_fields=("date_ist",),
        date_hint=", expected YYYY-MM-DD",
        count_field="records",
        count_max=96,
        count_over="records=%s exceeds expected 96 per day (multi-host?)",
        count_over_is_error=False,
    ),
    "weekly": Rules(
        required={"week_start": "string", "week_end": "string", "days": "int", **MEANS},
        date_fields=("week_start", "week_end"),
        count_field="days",
        count_max=7,
        count_over="days=%s exceeds 7 for a week",
        ranges={"avg_download": (0, 2000), "avg_upload": (0, 2000), "avg_ping": (0, 1000)},
    ),
    "monthly": Rules(
        required={"month": "string", "days": "int", **MEANS},
        count_field="days",
        count_max=31,
        count_over="days=%s exceeds 31 for a month",
        ranges={"avg_download": (0, 2000), "avg_upload": (0, 2000)},
    ),
    "yearly": Rules(
        required={"year": "int", "months_aggregated": "int", **MEANS},
        count_field="months_aggregated",
        count_max=12,
        count_over="months_aggregated=%s exceeds 12",
        ranges={"avg_download": (0, 2000), "avg_upload": (0, 2000)},
    ),
}
METRICS = ("download_mbps", "upload_mbps", "ping_ms")
KINDS = {
    "string": "= 'STRING'",
    "int": "= 'BIGINT'",
    "object": "LIKE 'OBJECT%'",
    "number": "RLIKE '^(BIGINT|DOUBLE|DECIMAL)'",
}


def _get(path: str, kind: str = "variant") -> str:
    return f"try_variant_get(v, '$.{path}', '{kind}')"


def _is(path: str, kind: str) -> str:
    return f"schema_of_variant({_get(path)}) {KINDS[kind]}"


def _number(path: str) -> str:
    """The field as a number, NULL when absent or not a number."""
    return f"if({_is(path, 'number')}, {_get(path, 'decimal(20,2)')}, null)"


def _shown(path: str) -> str:
    """The number as the document writes it."""
    return _get(path, "string")


def range_message(path: str, low: int, high: int, label: str) -> str:
    """SQL of the message for a number outside its range, NULL inside it."""
    value = _number(path)
    return (
        f"case when {value} < {low} then concat('{label}=', {_shown(path)}, ' is below minimum {low}') "
        f"when {value} > {high} then concat('{label}=', {_shown(path)}, ' is above maximum {high}') end"
    )


# The message texts below are fixed values too.
def _messages(level: str, as_of_year: int) -> tuple[list[str], list[str]]:
    rules = RULES[level]
    errors, warnings = [], []
    for name, kind in rules.required.items():
        errors.append(
            f"case when {_get(name)} is null then 'Missing required field: {name}' "
            f"when not {_is(name, kind)} then 'Field {name} has wrong type: expected {kind}' end"
        )
    for name in rules.date_fields:
        errors.append(
            f"case when {_is(name, 'string')} and (not {_shown(name)} rlike '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$' "
            f"or try_to_timestamp({_shown(name)}, 'yyyy-M-d') is null) "
            f"then concat('Invalid date format: ', {_shown(name)}, '{rules.date_hint}') end"
        )
    if level == "monthly":
        errors.append(
            f"case when {_is('month', 'string')} and not {_shown('month')} rlike '^[0-9]{{6}}$' "
            f"then concat('Invalid month format: ', {_shown('month')}, ', expected YYYYMM') end"
        )
    if level == "yearly":
        year = _number("year")
        errors.append(
            f"case when {year} < 2020 or {year} > {as_of_year + 1} "
            f"then concat('year=', {_shown('year')}, ' seems invalid') end"
        )
    if rules.stats:
        into = errors if rules.missing_stat_is_error else warnings
        for metric in METRICS:
            path = f"overall.{metric}"
            errors.append(
                f"case when {_is('overall', 'object')} and {_get(path)} is null "
                f"then 'Missing metric in overall: {metric}' end"
            )
            for stat in rules.stats:
                into.append(
                    f"case when {_is(path, 'object')} and {_get(f'{path}.{stat}')} is null "
                    f"then 'Missing stat {stat} in overall.{metric}' end"
                )
    count = rules.count_field
    errors.append(f"case when {_number(count)} < 0 then '{count} cannot be negative' end")
    warnings.append(f"case when {_number(count)} = 0 then '{count} is 0 - empty aggregation' end")
    over = f"case when {_number(count)} > {rules.count_max} then format_string('{rules.count_over}', {_shown(count)}) end"
    (errors if rules.count_over_is_error else warnings).append(over)
    if level == "daily":
        rate = "completion_rate"
        errors.append(
            f"case when {_number(rate)} < 0 then concat('{rate}=', {_shown(rate)}, ' cannot be negative') end"
        )
        warnings.append(
            f"case when {_number(rate)} > 100 then concat('{rate}=', {_shown(rate)}, "
            "'% exceeds 100% (multi-host or frequent tests)') end"
        )
    for path, (low, high) in rules.ranges.items():
        warnings.append(range_message(path, low, high, path.removeprefix("overall.")))
    return errors, warnings


def validate(documents: DataFrame, level: str, as_of_year: int) -> DataFrame:
    """``key, doc`` -> ``level, key, valid, errors, warnings``."""
    errors, warnings = _messages(level, as_of_year)

    def gathered(parts: list[str]) -> Column:
        return F.expr(f"array_compact(array({', '.join(parts)}))")

    parsed = documents.withColumn("v", F.try_parse_json("doc"))
    broken = F.col("v").isNull()
    none = F.array().cast("array<string>")
    return (
        parsed.withColumns(
            {
                "errors": F.when(broken, F.array(F.lit("Invalid JSON"))).otherwise(gathered(errors)),
                "warnings": F.when(broken, none).otherwise(gathered(warnings)),
                "level": F.lit(level),
            }
        )
        .withColumn("valid", F.size("errors") == 0)
        .select("level", "key", "valid", "errors", "warnings")
    )


def report(results: DataFrame) -> DataFrame:
    """Valid, invalid and warned documents of each level."""
    return results.groupBy("level").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if(F.col("valid") & (F.size("warnings") > 0)).alias("warnings"),
    )


def sample(documents: DataFrame, n: int, seed: str) -> DataFrame:
    """N documents in an order fixed by the seed: a top-N of hashes, not a full sort."""
    return documents.orderBy(F.md5(F.concat(F.lit(seed), F.col("key"))), "key").limit(n)


def restrict_to_manifest(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Only documents a manifest lists; both sides carry ``type`` and ``key``."""
    return documents.join(manifest.select("type", "key").distinct(), ["type", "key"], "left_semi")

"""Column expressions over the text fields of measurements, paths and log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted number and unit forms, address form, connection fallback.
READING = r"^\s*([+-]?[0-9]*\.?[0-9]+)(?:\s*(?:Mbps|mbps|Mbit/s|ms))?(?:\s.*)?$"
IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
UNKNOWN = "Unknown"
LABEL_SEPARATOR = " – "


def reading(text: Column) -> Column:
    """``"191.17 Mbps"`` or ``"6.58 ms"`` -> BIGINT hundredths; NULL when it does not parse.

    The number ends at a known unit or at a blank; more than two decimals are rounded.
    """
    number = F.nullif(F.regexp_extract(text, READING, 1), F.lit(""))
    return (number.try_cast("decimal(18,2)") * 100).cast("bigint")


def _present(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def server_label(name: Column, host: Column, city: Column, country: Column) -> Column:
    """``name – host – city (country)`` without the blank parts."""
    parts = F.concat_ws(LABEL_SEPARATOR, _present(name), _present(host), _present(city))
    country = _present(country)
    return F.when(country.isNull(), parts).otherwise(F.concat(parts, F.lit(" ("), country, F.lit(")")))


def full_server_label(name: Column, host: Column, city: Column, country: Column) -> Column:
    """The fixed template of the minute view; blanks keep their separators."""
    text = [F.coalesce(c, F.lit("")) for c in (name, host, city, country)]
    sep = F.lit(LABEL_SEPARATOR)
    return F.trim(F.concat(text[0], sep, text[1], sep, text[2], F.lit(" ("), text[3], F.lit(")")))


def joined(items: Column) -> Column:
    """``a, b`` or ``Unknown`` for a list without members."""
    return F.coalesce(F.nullif(F.array_join(items, ", "), F.lit("")), F.lit(UNKNOWN))


def first_or_blank(items: Column) -> Column:
    return F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(""))


def primary_connection(types: Column) -> Column:
    """First entry of a comma separated list."""
    return F.trim(F.split_part(types, F.lit(","), F.lit(1)))


def is_web_url(url: Column) -> Column:
    return F.coalesce(url.startswith("http"), F.lit(False))


def is_known_ip(ip: Column) -> Column:
    text = F.lower(F.trim(ip))
    return F.coalesce((text != "") & ~text.isin("unknown", "n/a"), F.lit(False))


def cidr24(ip: Column) -> Column:
    return F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))


def cidr16(ip: Column) -> Column:
    return F.concat(F.substring_index(ip, ".", 2), F.lit(".0.0/16"))


def ipv6_groups(ip: Column) -> Column:
    """The eight groups of an IPv6 address as numbers; NULL for any other text.

    Takes ``::`` in place of one group or more, an IPv4 address as the last two groups
    (its own bits are not told: they come as zeros), and a zone after ``%``.
    """
    plain = F.regexp_replace(F.lower(ip), r"%[^%/]+$", "")
    sides = F.split(F.regexp_replace(plain, "(?<=:)" + IPV4.strip("^$") + "$", "0:0"), "::", -1)
    parts = F.transform(sides, lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1)))
    known = F.aggregate(parts, F.lit(0), lambda n, side: n + F.size(side))
    spelled = F.forall(parts, lambda side: F.forall(side, lambda group: group.rlike("^[0-9a-f]{1,4}$")))
    whole = ((F.size(sides) == 1) & (known == 8)) | ((F.size(sides) == 2) & (known <= 7))
    groups = F.when(F.size(sides) == 1, parts[0]).otherwise(
        F.concat(parts[0], F.array_repeat(F.lit("0"), 8 - known), F.get(parts, F.lit(1)))
    )
    return F.when(whole & spelled, F.transform(groups, lambda group: F.conv(group, 16, 10).cast("int")))


def _ipv6_network(first: Column, second: Column, bits: int) -> Column:
    front = F.when((first == 0) & (second == 0), F.lit("")).otherwise(F.lower(F.hex(first)))
    return F.concat(front, F.when(second == 0, F.lit("")).otherwise(F.concat(F.lit(":"), F.lower(F.hex(second)))), F.lit(f"::/{bits}"))


def ipv6_cidr16(groups: Column) -> Column:
    return _ipv6_network(groups[0], F.lit(0), 16)


def ipv6_cidr24(groups: Column) -> Column:
    return _ipv6_network(groups[0], groups[1].bitwiseAND(F.lit(0xFF00)), 24)


def with_unit(value: Column, suffix: str) -> Column:
    """``12.30 Mbps`` or ``N/A``."""
    shown = F.format_string("%.2f" + suffix.replace("%", "%%"), value.cast("double"))
    return F.when(value.isNotNull(), shown).otherwise(F.lit("N/A"))


def severity(message: Column) -> Column:
    """Class of a log line from its text; START, END and REPORT lines have none."""
    return (
        F.when(message.rlike("^(START|END|REPORT) "), F.lit(None))
        .when(message.rlike("ERROR|Error|(?i)exception"), F.lit("error"))
        .when(message.contains("WARN"), F.lit("warning"))
        .when(message.contains("INFO"), F.lit("info"))
        .otherwise(F.lit("plain"))
    )


def function_of_group(group: Column, prefix: str = "", suffix: str = "-prod") -> Column:
    """Last path part of a log group without the deployment prefix and suffix."""
    name = F.element_at(F.split(group, "/"), -1)
    for part in (prefix, suffix):
        if part:
            name = F.replace(name, F.lit(part), F.lit(""))
    return name


def completed_function(message: Column) -> Column:
    """Function named by a completion line, in either wording."""
    found = F.regexp_extract(message, r"Completed(?: successfully)?: (\S+)", 1)
    return F.nullif(found, F.lit(""))


def duration_in_text(message: Column) -> Column:
    """Seconds written as ``in 1.25s``; NULL when the line has none."""
    return F.nullif(F.regexp_extract(message, r"in ([0-9.]+)s", 1), F.lit("")).try_cast("double")

"""Whole-number arithmetic for readings.

Readings carry two decimals, so they are held as BIGINT hundredths. Sums, means
and percentages of them are then exact, the same on every engine, and cheap to
aggregate: a BIGINT sum stays in the generated code, a wide DECIMAL does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def hundredths(value: Column) -> Column:
    """A number with two decimals as BIGINT hundredths (NULL stays NULL)."""
    return F.round(value * F.lit(100)).cast("bigint")


def from_hundredths(value: Column) -> Column:
    return value.cast("double") / F.lit(100.0)


def div_half_up(num: Column, den: Column) -> Column:
    """``num / den`` rounded to a whole number, halves away from zero; NULL unless den > 0.

    The sum of hundredths of 10^12 readings still fits a BIGINT; callers whose
    numerator is a product cast it to ``WIDE`` first.
    """
    size = F.call_function("div", F.abs(num) * 2 + den, den * 2)
    return F.when(den > 0, F.when(num < 0, -size).otherwise(size))


def mean_hundredths(total: Column, count: Column) -> Column:
    """Mean in hundredths, rounded to the second decimal."""
    return div_half_up(total, count)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part / whole * 100`` rounded to ``digits`` decimals, as DOUBLE."""
    scale = 10**digits
    return div_half_up(part * F.lit(100 * scale), whole).cast("double") / F.lit(float(scale))

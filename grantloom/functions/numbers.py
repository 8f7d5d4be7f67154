"""Rounding and ratio expressions that give the same digits on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THOUSAND = 1e3
MILLION = 1e6
BILLION = 1e9


def rounded(value: Column, digits: int) -> Column:
    """Rounding half away from zero through ``floor``.

    ``round`` on a double differs between engines for values such as 1.005;
    scaling, adding one half and flooring is plain IEEE arithmetic everywhere.
    """
    scale = 10.0**digits
    number = value.cast("double")
    size = F.floor(F.abs(number) * scale + 0.5) / scale
    return F.when(number < 0, F.lit(0.0) - size).otherwise(size)


def in_units(value: Column, unit: float, digits: int = 2) -> Column:
    return rounded(value.cast("double") / unit, digits)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``; NULL when the denominator is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return rounded(part.cast("double") * 100.0 / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def digest_number(key: Column, digits: int = 8) -> Column:
    """Leading hex digits of the md5 of ``key`` as a bigint."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, digits), 16, 10).cast("bigint")

"""Fiscal-year spans as bit masks and series.

A span of fiscal years is kept as one bigint with a bit per year, so years of many
awards merge with ``bit_or`` inside the aggregation instead of one row per award and year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reporting window of the year-expanded tables.
FIRST_REPORTED = 1985
LAST_REPORTED = 2024


def span_length(first: Column, last: Column) -> Column:
    return F.greatest(F.lit(1), last - first + 1)


def annual_share(total: Column, first: Column, last: Column) -> Column:
    return total.cast("double") / span_length(first, last)


def clipped(first: Column, last: Column) -> tuple[Column, Column, Column]:
    """Span inside the reporting window: its start, its end and its length in years."""
    start = F.greatest(first, F.lit(FIRST_REPORTED))
    end = F.least(last, F.lit(LAST_REPORTED))
    return start, end, F.greatest(F.lit(0), end - start + 1)


def span_mask(first: Column, last: Column) -> Column:
    """Bits of the reported years of a span; zero when none is reported."""
    start, _, length = clipped(first, last)
    ones = F.expr("bigint(1)")
    bits = F.call_function("shiftleft", ones, length) - 1
    return F.call_function("shiftleft", bits, start - FIRST_REPORTED)


def mask_years(mask: Column) -> Column:
    """The years of a mask in ascending order."""
    window = F.sequence(F.lit(FIRST_REPORTED), F.lit(LAST_REPORTED))
    return F.filter(
        window, lambda year: F.call_function("getbit", mask, year - FIRST_REPORTED) == 1
    )


def explode_reported(rows: DataFrame, first: str = "first_fiscal_year", last: str = "last_fiscal_year") -> DataFrame:
    """One row per reported fiscal year of the span.

    The series is clamped before it is generated, so no year outside the window is made.
    """
    start, end, length = clipped(F.col(first), F.col(last))
    return rows.where(length > 0).withColumn("fiscal_year", F.explode(F.sequence(start, end)))


def era(first: Column) -> Column:
    return F.when(first < 2005, "1990-2004").when(first < 2015, "2005-2014").otherwise("2015-2024")


def cost_band(cost: Column) -> Column:
    return F.when(cost < 250000, "LOW").when(cost < 750000, "MED").otherwise("HIGH")

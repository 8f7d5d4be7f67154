"""Interactive portfolio slices as composable filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantloom.functions.numbers import BILLION, MILLION, in_units, rounded


@dataclass(frozen=True)
class Slice:
    """A selection on the map; an empty set means no restriction."""

    units: frozenset[str] = field(default_factory=frozenset)
    first_year: int | None = None
    last_year: int | None = None
    keyword: str = ""
    domains: frozenset[int] = field(default_factory=frozenset)
    topics: frozenset[int] = field(default_factory=frozenset)
    search_ids: bool = False

    def condition(self) -> Column:
        test = F.lit(True)
        if self.units:
            test = test & F.col("ic").isin(*sorted(self.units))
        if self.first_year is not None:
            test = test & (F.col("fy") >= self.first_year)
        if self.last_year is not None:
            test = test & (F.col("fy") <= self.last_year)
        if self.keyword:
            word = F.lit(self.keyword.lower())
            found = F.contains(F.lower("title"), word)
            if self.search_ids:
                found = found | F.contains(F.lower(F.col("application_id").cast("string")), word)
            test = test & found
        if self.domains:
            test = test & F.col("domain").isin(*sorted(self.domains))
        if self.topics:
            test = test & F.col("topic").isin(*sorted(self.topics))
        return test


def selected(points: DataFrame, choice: Slice) -> DataFrame:
    return points.where(choice.condition())


def totals(points: DataFrame, choice: Slice) -> DataFrame:
    return selected(points, choice).agg(
        F.count(F.lit(1)).alias("grants"), in_units(F.sum("cost"), BILLION, 4).alias("funding_billions")
    )


def group_counts(points: DataFrame, choice: Slice, level: str) -> DataFrame:
    """Grants, funding and years per domain, topic or subtopic of the slice."""
    return selected(points, choice).groupBy(level).agg(
        F.count(F.lit(1)).alias("grants"),
        in_units(F.sum("cost"), MILLION).alias("funding_millions"),
        F.min("fy").alias("first_year"),
        F.max("fy").alias("last_year"),
    )


def topic_legend(points: DataFrame, limit: int = 25) -> DataFrame:
    """Largest topics with their centres."""
    return (
        points.groupBy("topic")
        .agg(
            F.count(F.lit(1)).alias("count"),
            rounded(F.avg("x"), 4).alias("x"),
            rounded(F.avg("y"), 4).alias("y"),
        )
        .orderBy(F.desc("count"), "topic")
        .limit(limit)
    )


def topic_totals(points: DataFrame, topics: list[int]) -> DataFrame:
    return totals(points, Slice(topics=frozenset(topics)))


def unit_facet(points: DataFrame) -> DataFrame:
    return points.select("ic").distinct().orderBy("ic")


def year_facet(points: DataFrame) -> DataFrame:
    return points.agg(F.min("fy").alias("fy_min"), F.max("fy").alias("fy_max"))


def award_bitmaps(points: DataFrame, award: str) -> DataFrame:
    """``ic, fy, domain, bucket, awards``: the awards of every unit, year and domain as bitmaps of 64 awards, a number each.

    Bitmaps merge by OR, so distinct awards of any slice follow from this roll-up without the rows; an award in many rows,
    years or units is one bit of each. Awards are spread thinly over units, years and domains, so a bitmap is no wider than
    a number: a group costs a few bytes, is added up before the shuffle and can be spilled. ``award`` is a number that is
    not negative.
    """
    number = F.col(award).cast("bigint")
    held = points.where(F.col(award).isNotNull()).select(
        "ic", "fy", "domain", F.shiftright(number, 6).alias("bucket"), number.bitwiseAND(63).cast("int").alias("place")
    ).withColumn("bit", F.expr("shiftleft(1L, place)"))
    return held.groupBy("ic", "fy", "domain", "bucket").agg(F.bit_or("bit").alias("awards"))


def distinct_awards(bitmaps: DataFrame, choice: Slice, *by: str) -> DataFrame:
    """Distinct awards of a slice by units, years and domains, per value of ``by`` or in all."""
    if choice.keyword or choice.topics:
        raise ValueError("bitmaps know units, years and domains only")
    merged = selected(bitmaps, choice).groupBy(*by, "bucket").agg(F.bit_or("awards").alias("awards"))
    return merged.groupBy(*by).agg(F.coalesce(F.sum(F.bit_count("awards")), F.lit(0)).alias("awards"))

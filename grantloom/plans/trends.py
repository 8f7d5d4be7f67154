"""Portfolio-wide yearly trends and agency portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.functions import mechanisms as m
from grantloom.functions.mechanisms import Slice, slice_columns
from grantloom.functions.numbers import BILLION, in_units, percent, ratio, rounded
from grantloom.functions.years import mask_years
from grantloom.operators.facets import attached, distinct_of, rollup, top_values
from grantloom.plans.institute import MEASURES, PEOPLE, SPAN_HIGH, SPAN_LOW

# Column names of the yearly breakdown; reported years.
PORTFOLIO_YEAR_SLICES = (
    Slice(m.RPG_STANDARD, "rpg_awards", "rpg_funding_b"),
    Slice(m.CENTERS, "center_awards", "center_funding_b"),
    Slice(m.COOPERATIVE, "coop_agreement_awards", "coop_agreement_funding_b"),
    Slice(m.TRAINING, "training_awards", "training_funding_b"),
    Slice(m.CAREER, "career_awards"),
    Slice(m.FELLOWSHIP, "fellowship_awards"),
)
TREND_YEARS = (2000, 2024)


def funded_years(awards: DataFrame) -> DataFrame:
    """The funded years of each award as a delimited list, the published form of ``year_mask``."""
    return awards.withColumn("fiscal_years_funded", F.array_join(mask_years(F.col("year_mask")), ", "))


def portfolio_trends(awards: DataFrame) -> DataFrame:
    """Awards and funding of every fiscal year, over the years an award was funded in.

    An award counts in a year of its span when the year occurs in its list of funded years.  Rows are
    rolled up per (activity, span, list) before years are generated.
    """
    first_year, last_year = TREND_YEARS
    share = F.col("total_lifetime_funding").cast("double") / F.col("distinct_fiscal_years")
    spans = ["activity", "first_fiscal_year", "last_fiscal_year", "fiscal_years_funded"]
    per_span = awards.groupBy(*spans).agg(F.count(F.lit(1)).alias("n"), F.sum(share).alias("funding"))
    low = F.greatest("first_fiscal_year", F.lit(first_year))
    high = F.least("last_fiscal_year", F.lit(last_year))
    years = (
        per_span.where(low <= high)
        .withColumn("fiscal_year", F.explode(F.sequence(low, high)))
        .where(F.contains("fiscal_years_funded", F.col("fiscal_year").cast("string")))
    )
    return years.groupBy("fiscal_year").agg(
        F.sum("n").alias("total_awards"),
        in_units(F.sum("funding"), BILLION).alias("total_funding_billions"),
        *slice_columns(PORTFOLIO_YEAR_SLICES, BILLION),
    )


def recent(trends: DataFrame, since: int = 2015) -> DataFrame:
    return trends.where(F.col("fiscal_year") >= since).orderBy("fiscal_year")


def agency_portfolio(awards: DataFrame) -> DataFrame:
    keys = ["department", "funding_agency", "organizational_category"]
    per_unit = rollup(
        awards, keys, "activity", MEASURES, SPAN_LOW, SPAN_HIGH, {"units": "administering_ic"}
    )
    return per_unit.groupBy(*keys).agg(
        F.sum("n").alias("num_awards"),
        distinct_of("units").alias("num_ics"),
        in_units(F.sum("funding"), BILLION).alias("funding_billions"),
        rounded(ratio(F.sum("publications"), F.sum("with_publications")), 1).alias("avg_pubs"),
        F.sum("mpi").alias("mpi_awards"),
        percent(F.sum("mpi"), F.sum("n")).alias("pct_mpi"),
        F.min("first_year").alias("earliest_year"),
        F.max("last_year").alias("latest_year"),
    )


def unit_portfolio(awards: DataFrame) -> DataFrame:
    """Units found in the dimension, with their most used mechanisms."""
    keys = ["department", "funding_agency", "ic_type", "administering_ic", "ic_full_name", "organizational_category"]
    known = awards.where(F.col("ic_full_name") != "Unknown IC")
    totals = rollup(known, keys, "activity", MEASURES | PEOPLE).groupBy(*keys).agg(
        F.sum("n").alias("num_awards"),
        in_units(F.sum("funding"), BILLION).alias("funding_billions"),
        rounded(ratio(F.sum("publications"), F.sum("with_publications")), 1).alias("avg_pubs"),
        rounded(ratio(F.sum("people"), F.sum("with_people")), 2).alias("avg_pi_count"),
        F.sum("mpi").alias("mpi_awards"),
        percent(F.sum("mpi"), F.sum("n")).alias("pct_mpi"),
    )
    tops = top_values(known, ["administering_ic"], {"top_mechanisms": ("activity", 5)})
    return attached(totals, tops, ["administering_ic"]).withColumnRenamed("ic_full_name", "ic_name")

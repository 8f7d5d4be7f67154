"""Institution cards: departments, yearly trends, specialisation, places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantloom.functions import mechanisms as m
from grantloom.functions import names
from grantloom.functions.mechanisms import Slice, slice_columns
from grantloom.functions.numbers import BILLION, MILLION, in_units, percent, ratio, rounded
from grantloom.functions.years import annual_share, explode_reported, span_mask
from grantloom.operators.facets import distinct_of, rollup, top_values, yearly_distinct
from grantloom.plans.institute import MEASURES, SPAN_HIGH, SPAN_LOW, TREND_SLICES, spread_over, yearly_top

# Column names of the mechanism breakdowns.
ORGANIZATION_SLICES = (
    Slice(m.RPG_STANDARD, "rpg_total", "rpg_funding_b"),
    Slice(m.HIGH_RISK_PEOPLE, "high_risk_total"),
    Slice(m.CENTERS, "center_total", "center_funding_b"),
    Slice(m.only("P30"), "p30_core_grants"),
    Slice(m.only("P50"), "p50_specialized_centers"),
    Slice(m.COOPERATIVE, "coop_agreement_total", "coop_agreement_funding_b"),
    Slice(m.only("UL1"), "ul1_ctsa_awards"),
    Slice(m.only("U54"), "u54_awards"),
    Slice(m.TRAINING, "training_total"),
    Slice(m.only("T32"), "t32_awards"),
    Slice(m.CAREER, "career_total"),
    Slice(m.FELLOWSHIP, "fellowship_total"),
    Slice(m.SMALL_BUSINESS_GRANTS, "sbir_total"),
    Slice(m.INFRASTRUCTURE, "infrastructure_total"),
    Slice(m.only("G12"), "g12_rcmi_awards"),
    Slice(m.only("S06"), "s06_mbrs_awards"),
    Slice(m.only("C06"), "c06_construction_awards"),
)
ORGANIZATION_SLICES_ALL_MECHANISMS = (
    *ORGANIZATION_SLICES,
    Slice(m.CONTRACTS, "contract_total"),
    Slice(m.INTRAMURAL, "intramural_total"),
)
COMPLETE_SLICES = (
    Slice(m.RPG_WIDE, "rpg_total", "rpg_funding_b"),
    Slice(m.CENTERS, "center_total", "center_funding_b"),
    Slice(m.FELLOWSHIP_CAREER_CODES, "fellowship_total", "fellowship_funding_b"),
    Slice(m.TRAINING_CODES, "training_total", "training_funding_b"),
    Slice(m.SMALL_BUSINESS, "sbir_total", "sbir_funding_b"),
)
YEARLY_SLICES = (
    *TREND_SLICES,
    Slice(m.only("R15"), "area_awards", "area_funding_m"),
    Slice(m.MINORITY_SERVING, "minority_serving_awards", "minority_serving_funding_m"),
    Slice(m.only("UL1"), "ctsa_awards", "ctsa_funding_m"),
)
SPECIAL_SLICES = (
    Slice(m.only("R15"), "area_total_awards", "area_total_funding_m"),
    Slice(m.MINORITY_SERVING, "minority_serving_awards", "minority_serving_funding_m"),
    Slice(m.only("UL1"), "ctsa_awards", "ctsa_funding_m"),
    Slice(m.SPECIALIZED_CENTERS, "specialized_center_awards", "specialized_center_funding_m"),
    Slice(m.CONSTRUCTION, "infrastructure_awards", "infrastructure_funding_m"),
)
MINIMUM_AWARDS = 10


def at_institution(awards: DataFrame) -> DataFrame:
    return awards.where(F.col("primary_org").isNotNull()).withColumn("institution", F.col("primary_org"))


def external_only(awards: DataFrame) -> DataFrame:
    """Leaves out the funder's own laboratories."""
    return awards.where(names.external_organization(F.col("primary_org")))


def without_internal_mechanisms(awards: DataFrame) -> DataFrame:
    return awards.where(f"not {m.INTRAMURAL.sql()} and not {m.CONTRACTS.sql()}")


def comprehensive_cards(awards: DataFrame, slices: tuple[Slice, ...] = ORGANIZATION_SLICES) -> DataFrame:
    """Cards per institution and state with at least ten awards.

    Base figures belong to (institution, state); the breakdown belongs to the institution and repeats
    on each of its states.
    """
    keys = ["institution", "state"]
    rows = at_institution(awards).withColumn("state", F.col("primary_state"))
    per_code = rollup(rows, keys, "activity", MEASURES, SPAN_LOW, SPAN_HIGH, {"units": "administering_ic"})
    cards = per_code.groupBy(*keys).agg(
        F.sum("n").alias("total_awards"),
        in_units(F.sum("funding"), BILLION).alias("total_funding_billions"),
        distinct_of("units").alias("num_ics"),
        F.min("first_year").alias("earliest_year"),
        F.max("last_year").alias("latest_year"),
        F.sum("publications").alias("total_publications"),
        F.sum("mpi").alias("total_mpi_awards"),
        percent(F.sum("mpi"), F.sum("n")).alias("pct_collaborative"),
        *slice_columns(slices, None),
    )
    return spread_over(cards, ["institution"], slices, BILLION).where(F.col("total_awards") >= MINIMUM_AWARDS)


def departments(awards: DataFrame) -> DataFrame:
    keys = ["institution", "department"]
    rows = at_institution(awards).where(names.present(F.col("org_dept"))).withColumn("department", F.col("org_dept"))
    per_code = rollup(
        rows, keys, "activity", MEASURES, SPAN_LOW, SPAN_HIGH,
        {"pis": "contact_pi_name", "domains": "domain_id", "topics": "cluster_id"},
    )
    cards = per_code.groupBy(*keys).agg(
        F.sum("n").alias("dept_awards"),
        in_units(F.sum("funding"), MILLION).alias("dept_funding_millions"),
        distinct_of("pis").alias("dept_active_pis"),
        distinct_of("domains").alias("dept_domains"),
        distinct_of("topics").alias("dept_topics"),
        F.min("first_year").alias("dept_first_year"),
        F.max("last_year").alias("dept_last_year"),
        F.sum("mpi").alias("dept_mpi_awards"),
        percent(F.sum("mpi"), F.sum("n")).alias("dept_pct_collaborative"),
        F.sum("publications").alias("dept_publications"),
    )
    cards = cards.join(top_values(rows, keys, {"dept_top_topics": ("cluster_label", 3)}), keys, "left")
    order = Window.partitionBy("institution").orderBy(F.desc("dept_funding_millions"), "department")
    return cards.withColumn("dept_funding_rank", F.row_number().over(order))


def yearly_trends(awards: DataFrame) -> DataFrame:
    """One row per institution and reported fiscal year; see the unit trends for the method."""
    entity = ["institution"]
    rows = at_institution(awards)
    first, last = F.col("first_fiscal_year"), F.col("last_fiscal_year")
    per_span = rows.groupBy(*entity, "activity", "first_fiscal_year", "last_fiscal_year").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(annual_share(F.col("total_lifetime_funding"), first, last)).alias("funding"),
    )
    per_year = explode_reported(per_span).groupBy(*entity, "fiscal_year").agg(
        F.sum("n").alias("num_awards"),
        in_units(F.sum("funding"), MILLION).alias("funding_millions"),
        *slice_columns(YEARLY_SLICES, MILLION),
    )
    people = yearly_distinct(rows, entity, span_mask(first, last), {"num_active_pis": "contact_pi_name"})
    topics = yearly_top(rows, entity, "cluster_label", "top_topics_this_year", 5)
    keys = [*entity, "fiscal_year"]
    return per_year.join(people, keys, "left").join(topics, keys, "left").fillna(0, ["num_active_pis"])


def specialization(awards: DataFrame) -> DataFrame:
    per_code = at_institution(awards).groupBy("institution", "activity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_lifetime_funding").alias("funding")
    )
    totals = per_code.groupBy("institution").agg(
        F.sum("n").alias("total_awards"),
        in_units(F.sum("funding"), BILLION).alias("total_funding_billions"),
        *slice_columns(SPECIAL_SLICES, MILLION),
    )
    kind = (
        F.when(F.col("ctsa_awards") > 0, "Academic Medical Center")
        .when(F.col("area_total_awards") > 5, "Undergraduate-Focused")
        .when(F.col("minority_serving_awards") > 0, "Minority-Serving Institution")
        .when(F.col("specialized_center_awards") >= 3, "Specialized Research Center")
        .otherwise("Research University")
    )
    return totals.withColumns(
        {
            "pct_area": percent(F.col("area_total_awards"), F.col("total_awards")),
            "pct_minority_serving": percent(F.col("minority_serving_awards"), F.col("total_awards")),
            "institution_type": kind,
        }
    )


def geography(awards: DataFrame) -> DataFrame:
    keys = ["institution", "state", "city", "country", "zipcode"]
    rows = at_institution(awards).withColumns(
        {
            "state": F.col("primary_state"),
            "city": F.col("org_city"),
            "country": F.col("org_country"),
            "zipcode": F.col("org_zipcode"),
        }
    )
    return (
        rollup(rows, keys, "activity", MEASURES, distinct={"pis": "contact_pi_name"})
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("awards_in_location"),
            in_units(F.sum("funding"), MILLION).alias("funding_millions"),
            distinct_of("pis").alias("pis_in_location"),
        )
    )


def _base(rows: DataFrame) -> DataFrame:
    per_code = rollup(
        rows, ["institution"], "activity", MEASURES, SPAN_LOW, SPAN_HIGH,
        {"domains": "domain_id", "topics": "cluster_id", "pis": "contact_pi_name", "units": "administering_ic"},
    )
    return per_code.groupBy("institution").agg(
        F.sum("n").alias("total_awards"),
        in_units(F.sum("funding"), BILLION).alias("total_funding_billions"),
        distinct_of("domains").alias("num_domains"),
        distinct_of("topics").alias("num_topics"),
        distinct_of("pis").alias("total_unique_pis"),
        F.min("first_year").alias("first_award_year"),
        F.max("last_year").alias("last_award_year"),
        F.sum("mpi").alias("total_mpi_awards"),
        percent(F.sum("mpi"), F.sum("n")).alias("pct_collaborative"),
        F.sum("publications").alias("total_publications"),
        rounded(ratio(F.sum("publications"), F.sum("with_publications")), 1).alias("avg_pubs_per_award"),
        distinct_of("units").alias("num_funding_ics"),
        *slice_columns(COMPLETE_SLICES, BILLION),
    )


def complete_cards(awards: DataFrame, limit: int = 500) -> DataFrame:
    """Full card of the best-funded institutions, with their ten best-funded departments."""
    rows = at_institution(awards)
    base = (
        _base(rows)
        .where(F.col("total_awards") >= MINIMUM_AWARDS)
        .orderBy(F.desc("total_funding_billions"), "institution")
        .limit(limit)
    )
    mine = awards.join(
        F.broadcast(base.select(F.col("institution").alias("primary_org"))), "primary_org", "left_semi"
    )
    mine_rows = at_institution(mine)
    tops = top_values(mine_rows, ["institution"], {"top_domains": ("domain_name", 5), "top_topics": ("cluster_label", 10)})
    ranked = departments(mine)
    cell = F.struct(
        "dept_funding_rank", "department", "dept_funding_millions", "dept_awards", "dept_active_pis"
    )
    offices = ranked.groupBy("institution").agg(
        F.count(F.lit(1)).alias("num_departments_with_funding"),
        F.array_sort(F.collect_list(F.when(F.col("dept_funding_rank") <= 10, cell))).alias("top_departments"),
    )
    kinds = specialization(mine).select(
        "institution", "institution_type", "area_total_awards", "area_total_funding_m", "pct_area",
        "minority_serving_awards", "pct_minority_serving", "ctsa_awards", "specialized_center_awards",
    )
    places = mine_rows.groupBy("institution").agg(
        F.min("primary_state").alias("state"), F.min("org_city").alias("city"), F.min("org_country").alias("country")
    )
    result = base
    for part in (tops, offices, kinds, places):
        result = result.join(part, "institution", "left")
    return result


def top_institutions(awards: DataFrame, limit: int = 50) -> DataFrame:
    rows = at_institution(awards)
    best = (
        _base(rows)
        .where(F.col("total_awards") >= MINIMUM_AWARDS)
        .orderBy(F.desc("total_funding_billions"), "institution")
        .limit(limit)
        .select(
            "institution", "total_awards", F.col("total_funding_billions").alias("funding_billions"), "num_domains",
            "num_topics", F.col("total_unique_pis").alias("num_contact_pis"), "total_publications",
            "avg_pubs_per_award", F.col("total_mpi_awards").alias("mpi_awards"), "pct_collaborative",
            "num_funding_ics", "first_award_year", "last_award_year",
        )
    )
    mine = rows.join(F.broadcast(best.select("institution")), "institution", "left_semi")
    tops = top_values(mine, ["institution"], {"top_research_domains": ("domain_name", 5)})
    return (
        best.join(tops, "institution", "left")
        .withColumn("top_domain", F.get("top_research_domains", 0)["value"])
        .withColumnRenamed("institution", "institution_name")
    )

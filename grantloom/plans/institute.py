"""Funding-unit cards and yearly trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantloom.functions import mechanisms as m
from grantloom.functions.mechanisms import Slice, slice_columns
from grantloom.functions.numbers import BILLION, MILLION, in_units, percent, ratio, rounded
from grantloom.functions.years import annual_share, explode_reported, span_mask
from grantloom.operators.facets import attached, distinct_of, rollup, top_of_counts, top_values, yearly_distinct

# Column names of the mechanism breakdown.
UNIT_SLICES = (
    Slice(m.RPG_STANDARD, "rpg_standard_count", "rpg_standard_funding_b"),
    Slice(m.HIGH_RISK, "high_risk_count", "high_risk_funding_b"),
    Slice(m.CENTERS, "centers_p_count", "centers_p_funding_b"),
    Slice(m.only("P01"), "p01_program_projects"),
    Slice(m.only("P30"), "p30_center_core"),
    Slice(m.only("P50"), "p50_specialized_centers"),
    Slice(m.COOPERATIVE, "coop_agreements_u_count", "coop_agreements_u_funding_b"),
    Slice(m.only("U01"), "u01_research_coop"),
    Slice(m.only("UL1"), "ul1_ctsa"),
    Slice(m.only("U54"), "u54_specialized_centers"),
    Slice(m.only("U19"), "u19_research_programs"),
    Slice(m.TRAINING, "training_t_count", "training_t_funding_b"),
    Slice(m.only("T32"), "t32_institutional_training"),
    Slice(m.only("T35"), "t35_short_term_training"),
    Slice(m.CAREER, "career_dev_count", "career_dev_funding_b"),
    Slice(m.only("K99"), "k99_pathway_independence"),
    Slice(m.only("K01"), "k01_mentored_scientist"),
    Slice(m.only("K08"), "k08_clinical_scientist"),
    Slice(m.only("K23"), "k23_patient_oriented"),
    Slice(m.FELLOWSHIP, "fellowship_count", "fellowship_funding_b"),
    Slice(m.only("F31"), "f31_predoctoral"),
    Slice(m.only("F32"), "f32_postdoctoral"),
    Slice(m.only("F30"), "f30_md_phd"),
    Slice(m.SMALL_BUSINESS, "sbir_sttr_count", "sbir_sttr_funding_b"),
    Slice(m.INFRASTRUCTURE, "infrastructure_count", "infrastructure_funding_b"),
    Slice(m.only("G12"), "g12_rcmi_minority"),
    Slice(m.only("S06"), "s06_mbrs_minority"),
    Slice(m.only("C06"), "c06_construction"),
)
UNIT_SLICES_ALL_MECHANISMS = (
    Slice(m.RPG_STANDARD, "rpg_count", "rpg_funding_b"),
    Slice(m.HIGH_RISK, "high_risk_count", "high_risk_funding_b"),
    Slice(m.CENTERS, "centers_count", "centers_funding_b"),
    Slice(m.only("P01"), "p01_count"),
    Slice(m.only("P30"), "p30_count"),
    Slice(m.only("P50"), "p50_count"),
    Slice(m.COOPERATIVE, "coop_agreements_count", "coop_agreements_funding_b"),
    Slice(m.only("U01"), "u01_count"),
    Slice(m.only("UL1"), "ul1_ctsa_count"),
    Slice(m.only("U54"), "u54_count"),
    Slice(m.TRAINING, "training_count", "training_funding_b"),
    Slice(m.only("T32"), "t32_count"),
    Slice(m.CAREER, "career_count", "career_funding_b"),
    Slice(m.FELLOWSHIP, "fellowship_count", "fellowship_funding_b"),
    Slice(m.SMALL_BUSINESS, "sbir_count", "sbir_funding_b"),
    Slice(m.INFRASTRUCTURE, "infrastructure_count", "infrastructure_funding_b"),
    Slice(m.only("G12"), "g12_rcmi_count"),
    Slice(m.only("S06"), "s06_mbrs_count"),
    Slice(m.CONTRACTS, "contract_count", "contract_funding_b"),
    Slice(m.only("N01"), "n01_research_contracts"),
    Slice(m.INTRAMURAL, "intramural_count", "intramural_funding_b"),
    Slice(m.only("Z01"), "z01_intramural_research"),
    Slice(m.only("ZIA"), "zia_intramural_research"),
)
COMPLETE_SLICES = (
    Slice(m.RPG_WIDE, "rpg_total_awards", "rpg_total_funding_b"),
    Slice(m.CENTERS, "center_total_awards", "center_total_funding_b"),
    Slice(m.FELLOWSHIP_CAREER_CODES, "fellowship_total_awards", "fellowship_total_funding_b"),
    Slice(m.TRAINING_CODES, "training_total_awards", "training_total_funding_b"),
    Slice(m.SMALL_BUSINESS, "sbir_total_awards", "sbir_total_funding_b"),
)
# Unit codes left out of the trimmed cards.
SPELLED_OUT_UNITS = ("AI", "CA", "HL", "GM", "HD", "DK", "NS", "AG", "MH", "DA", "ES", "EY", "EB", "RR")

MEASURES = {
    "funding": "total_lifetime_funding",
    "publications": "publication_count",
    "with_publications": "int(publication_count is not null)",
    "mpi": "int(is_mpi)",
}
PEOPLE = {"people": "pi_count", "with_people": "int(pi_count is not null)"}
SPAN_LOW = {"first_year": "first_fiscal_year"}
SPAN_HIGH = {"last_year": "last_fiscal_year"}


def spread_over(rows: DataFrame, entity: list[str], slices: tuple[Slice, ...], unit: float) -> DataFrame:
    """Replaces the breakdown of each row by the breakdown of its whole entity.

    The breakdown belongs to the entity while base rows may be finer (entity, state); it is summed
    over the few base rows of an entity after aggregation.
    """
    whole = Window.partitionBy(*entity)
    columns = {}
    for item in slices:
        columns[item.count] = F.sum(item.count).over(whole)
        if item.funding:
            columns[item.funding] = in_units(F.sum(item.funding).over(whole), unit)
    return rows.withColumns(columns)


def comprehensive_cards(
    awards: DataFrame, slices: tuple[Slice, ...] = UNIT_SLICES, average_publications: bool = True
) -> DataFrame:
    """Cards per funding unit with counts and funding for every mechanism family."""
    keys = ["administering_ic", "ic_name", "agency"]
    known = awards.where(F.col("administering_ic").isNotNull())
    per_code = rollup(
        known, keys, "activity", MEASURES, SPAN_LOW, SPAN_HIGH, {"institutions": "primary_org"}
    )
    base = [
        F.sum("n").alias("total_projects"),
        F.sum("funding").cast("double").alias("total_funding"),
        in_units(F.sum("funding"), BILLION).alias("total_funding_billions"),
        distinct_of("institutions").alias("total_institutions"),
        F.coalesce(F.sum("mpi"), F.lit(0)).alias("total_mpi_awards"),
        percent(F.sum("mpi"), F.sum("n")).alias("pct_mpi"),
        F.sum("publications").alias("total_publications"),
        rounded(ratio(F.sum("publications"), F.sum("with_publications")), 1).alias("avg_pubs_per_award"),
        F.min("first_year").alias("earliest_year"),
        F.max("last_year").alias("latest_year"),
    ]
    cards = per_code.groupBy(*keys).agg(*base, *slice_columns(slices, None))
    cards = spread_over(cards, ["administering_ic"], slices, BILLION)
    return cards if average_publications else cards.drop("avg_pubs_per_award", "total_funding")


def trimmed_cards(cards: DataFrame) -> DataFrame:
    code = F.col("administering_ic")
    return cards.where(~code.isin(*SPELLED_OUT_UNITS) | code.isNull())


def mechanism_shares(cards: DataFrame, limit: int = 15) -> DataFrame:
    """Largest units with the funding share of the main families."""
    whole = F.col("total_funding_billions")
    return (
        cards.orderBy(F.desc("total_funding_billions"), "administering_ic")
        .limit(limit)
        .select(
            "administering_ic", "ic_name", "total_projects", "total_funding_billions",
            "rpg_standard_count", "centers_p_count", "coop_agreements_u_count", "training_t_count",
            "career_dev_count", "fellowship_count",
            percent(F.col("rpg_standard_funding_b"), whole).alias("pct_rpg"),
            percent(F.col("centers_p_funding_b"), whole).alias("pct_centers"),
            percent(F.col("coop_agreements_u_funding_b"), whole).alias("pct_coop_agreements"),
            "ul1_ctsa", "t32_institutional_training",
        )
    )


def yearly_trends(awards: DataFrame) -> DataFrame:
    """One row per funding unit and reported fiscal year.

    Measures are rolled up per span before years are generated; distinct people and institutions
    per year come from merged year masks; topics are counted per span first as well.
    """
    unit = ["administering_ic"]
    spans = ["first_fiscal_year", "last_fiscal_year"]
    share = annual_share(F.col("total_lifetime_funding"), F.col("first_fiscal_year"), F.col("last_fiscal_year"))
    per_span = awards.groupBy(*unit, "activity", *spans).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(share).alias("funding"),
        F.sum("publication_count").alias("publications"),
        F.sum(F.col("is_mpi").cast("int")).alias("mpi"),
        F.sum("pi_count").alias("people"),
        F.count("pi_count").alias("with_people"),
        F.count_if(F.expr(m.EARLY_INVESTIGATOR.sql())).alias("early"),
    )
    per_year = explode_reported(per_span).groupBy(*unit, "fiscal_year").agg(
        F.sum("n").alias("num_awards"),
        in_units(F.sum("funding"), MILLION).alias("funding_millions"),
        F.sum("publications").alias("num_publications"),
        F.sum("early").alias("num_likely_esi_ni"),
        *slice_columns(TREND_SLICES, MILLION),
        F.sum("mpi").alias("mpi_awards"),
        rounded(ratio(F.sum("people"), F.sum("with_people")), 2).alias("avg_pis_per_award"),
    )
    mask = span_mask(F.col("first_fiscal_year"), F.col("last_fiscal_year"))
    people = yearly_distinct(
        awards, unit, mask, {"num_unique_pis": "contact_pi_name", "num_institutions": "primary_org"}
    )
    topics = yearly_top(awards, unit, "cluster_label", "top_topics", 5)
    keys = [*unit, "fiscal_year"]
    return attached(attached(per_year, people, keys), topics, keys).fillna(0, ["num_unique_pis", "num_institutions"])


# Column names of the yearly breakdown.
TREND_SLICES = (
    Slice(m.RPG_WIDE, "rpg_awards", "rpg_funding_m"),
    Slice(m.CENTERS, "center_awards", "center_funding_m"),
    Slice(m.FELLOWSHIP_CAREER_CODES, "fellowship_awards", "fellowship_funding_m"),
    Slice(m.TRAINING_CODES, "training_awards", "training_funding_m"),
    Slice(m.SMALL_BUSINESS, "sbir_awards", "sbir_funding_m"),
)


def yearly_top(awards: DataFrame, keys: list[str], value: str, name: str, k: int) -> DataFrame:
    """Most frequent ``value`` per (keys, fiscal_year), counted per span before expansion."""
    counted = (
        awards.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("value"), "first_fiscal_year", "last_fiscal_year")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    yearly = explode_reported(counted).groupBy(*keys, "fiscal_year", "value").agg(F.sum("n").alias("n"))
    return top_of_counts(yearly.withColumn("facet", F.lit(name)), [*keys, "fiscal_year"], {name: k})


def complete_cards(awards: DataFrame) -> DataFrame:
    """Cards of clustered awards per funding unit and organisational category."""
    keys = ["administering_ic", "organizational_category"]
    per_code = rollup(
        awards,
        keys,
        "activity",
        MEASURES | PEOPLE,
        SPAN_LOW,
        SPAN_HIGH,
        {
            "domains": "domain_id",
            "topics": "cluster_id",
            "pis": "contact_pi_name",
            "institutions": "primary_org",
        },
    )
    cards = per_code.groupBy(*keys).agg(
        F.sum("n").alias("total_awards"),
        in_units(F.sum("funding"), BILLION).alias("total_funding_billions"),
        distinct_of("domains").alias("num_domains"),
        distinct_of("topics").alias("num_topics"),
        distinct_of("pis").alias("total_unique_pis"),
        distinct_of("institutions").alias("total_institutions"),
        F.sum("publications").alias("total_publications"),
        rounded(ratio(F.sum("publications"), F.sum("with_publications")), 1).alias("avg_pubs_per_award"),
        F.sum("mpi").alias("total_mpi_awards"),
        percent(F.sum("mpi"), F.sum("n")).alias("pct_mpi"),
        rounded(ratio(F.sum("people"), F.sum("with_people")), 2).alias("avg_pis_per_award"),
        F.min("first_year").alias("earliest_year"),
        F.max("last_year").alias("latest_year"),
        *slice_columns(COMPLETE_SLICES, None),
    )
    cards = spread_over(cards, ["administering_ic"], COMPLETE_SLICES, BILLION)
    tops = top_values(
        awards, keys, {"top_domains": ("domain_name", 5), "top_clusters": ("cluster_label", 10)}
    )
    return attached(cards, tops, keys)


def active_periods(cards: DataFrame, limit: int = 10) -> DataFrame:
    return (
        cards.orderBy(F.desc("total_funding_billions"), "administering_ic")
        .limit(limit)
        .select(
            "administering_ic", "total_funding_billions", "total_awards", "total_unique_pis", "total_institutions",
            F.concat_ws("-", "earliest_year", "latest_year").alias("active_period"),
            "rpg_total_awards", "center_total_awards", "fellowship_total_awards", "training_total_awards",
            "sbir_total_awards",
        )
    )


def unit_summary(awards: DataFrame) -> DataFrame:
    """Short summary per funding unit and category."""
    keys = ["administering_ic", "organizational_category"]
    per_code = rollup(
        awards,
        keys,
        "activity",
        MEASURES | PEOPLE,
        SPAN_LOW,
        SPAN_HIGH,
        {"domains": "domain_id", "topics": "cluster_id", "institutions": "primary_org"},
    )
    return per_code.groupBy(*keys).agg(
        F.sum("n").alias("total_awards"),
        in_units(F.sum("funding"), BILLION).alias("funding_billions"),
        distinct_of("domains").alias("num_domains"),
        distinct_of("topics").alias("num_topics"),
        distinct_of("institutions").alias("num_institutions"),
        F.sum("publications").alias("total_publications"),
        rounded(ratio(F.sum("publications"), F.sum("with_publications")), 1).alias("avg_pubs_per_award"),
        F.sum("mpi").alias("mpi_awards"),
        percent(F.sum("mpi"), F.sum("n")).alias("pct_mpi"),
        rounded(ratio(F.sum("people"), F.sum("with_people")), 2).alias("avg_pis_per_award"),
        F.min("first_year").alias("earliest_year"),
        F.max("last_year").alias("latest_year"),
    )

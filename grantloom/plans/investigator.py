"""Investigator cards: mobility, collaboration, portfolio and impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantloom.functions import mechanisms as m
from grantloom.functions import names
from grantloom.functions.mechanisms import Slice, slice_columns
from grantloom.functions.numbers import MILLION, in_units, percent, ratio, rounded
from grantloom.functions.years import LAST_REPORTED, annual_share, clipped, span_length, span_mask
from grantloom.operators.facets import attached, distinct_of, rollup, top_values
from grantloom.plans.institute import MEASURES, SPAN_HIGH, SPAN_LOW

# Column names of the mechanism breakdowns.
PERSON_SLICES = (
    Slice(m.RPG_STANDARD, "rpg_awards", "rpg_funding_m"),
    Slice(m.HIGH_RISK_PEOPLE, "high_risk_awards", "high_risk_funding_m"),
    Slice(m.CENTERS, "center_awards", "center_funding_m"),
    Slice(m.COOPERATIVE, "coop_agreement_awards", "coop_agreement_funding_m"),
    Slice(m.TRAINING, "training_awards"),
    Slice(m.CAREER, "career_awards"),
    Slice(m.only("K99"), "k99_awards"),
    Slice(m.FELLOWSHIP, "fellowship_awards"),
    Slice(m.SMALL_BUSINESS_GRANTS, "sbir_awards"),
    Slice(m.INFRASTRUCTURE, "infrastructure_awards"),
)
PERSON_SLICES_ALL_MECHANISMS = (
    Slice(m.RPG_STANDARD, "rpg_awards", "rpg_funding_m"),
    Slice(m.HIGH_RISK_PEOPLE, "high_risk_awards"),
    Slice(m.CENTERS, "center_awards"),
    Slice(m.COOPERATIVE, "coop_agreement_awards"),
    Slice(m.TRAINING, "training_awards"),
    Slice(m.CAREER, "career_awards"),
    Slice(m.FELLOWSHIP, "fellowship_awards"),
    Slice(m.SMALL_BUSINESS_GRANTS, "sbir_awards"),
    Slice(m.INFRASTRUCTURE, "infrastructure_awards"),
    Slice(m.CONTRACTS, "contract_awards"),
    Slice(m.INTRAMURAL, "intramural_awards"),
)
PORTFOLIO_SLICES = (
    Slice(m.RPG_WIDE, "rpg_awards", "rpg_funding_m"),
    Slice(m.CENTERS, "center_awards", "center_funding_m"),
    Slice(m.FELLOWSHIP_CAREER_CODES, "fellowship_awards", "fellowship_funding_m"),
    Slice(m.TRAINING_CODES, "training_awards", "training_funding_m"),
    Slice(m.SMALL_BUSINESS, "sbir_awards", "sbir_funding_m"),
)
MINIMUM_AWARDS = 3


def with_first_person(awards: DataFrame, cleaned: bool) -> DataFrame:
    """Awards with a people list; the contact person is its first entry."""
    people = F.col("all_pis")
    listed = awards.where(names.present(people))
    lead = names.first_person(names.without_contact_mark(people) if cleaned else people)
    return listed.withColumn("contact_pi_name", lead)


def named_person(name: Column, well_formed: bool = False) -> Column:
    test = names.present(name) & (name != names.UNNAMED_PERSON)
    return test & ~name.like(names.MALFORMED_PERSON) if well_formed else test


def comprehensive_cards(people: DataFrame, slices: tuple[Slice, ...]) -> DataFrame:
    """People with at least three awards; expects one contact person per award row."""
    key = ["contact_pi_name"]
    per_code = rollup(
        people, key, "activity", MEASURES, SPAN_LOW, SPAN_HIGH,
        {"units": "administering_ic", "organizations": "primary_org"},
    )
    cards = per_code.groupBy(*key).agg(
        F.sum("n").alias("total_awards"),
        in_units(F.sum("funding"), MILLION).alias("total_funding_millions"),
        distinct_of("units").alias("num_ics_funded_by"),
        distinct_of("organizations").alias("num_institutions_worked"),
        F.min("first_year").alias("career_start_year"),
        F.max("last_year").alias("career_last_active_year"),
        (F.max("last_year") - F.min("first_year")).alias("career_span_years"),
        F.sum("publications").alias("total_publications"),
        F.sum("mpi").alias("total_mpi_awards"),
        percent(F.sum("mpi"), F.sum("n")).alias("pct_collaborative"),
        *slice_columns(slices, MILLION),
    ).where(F.col("total_awards") >= MINIMUM_AWARDS)
    return cards.join(_listings(people, key), key, "left")


def _listings(people: DataFrame, key: list[str]) -> DataFrame:
    """First five institutions and all funding units as text.

    Distinct pairs are made before collecting.  Institutions are cut to five per task and person by
    the rank filter; the number of funding units is bounded by the unit dimension.
    """
    from pyspark.sql import Window

    pairs = people.select(*key, F.col("primary_org").alias("name")).where(F.col("name").isNotNull()).distinct()
    order = Window.partitionBy(*key).orderBy("name")
    first_five = pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 5)
    organizations = first_five.groupBy(*key).agg(names.joined_distinct(F.col("name"), " | ").alias("institutions"))
    units = people.groupBy(*key).agg(names.joined_distinct(F.col("administering_ic"), ", ").alias("ics_funded_by"))
    return units.join(organizations, key, "left").withColumn("institutions", F.coalesce("institutions", F.lit("")))


def institutional_history(awards: DataFrame) -> DataFrame:
    """Years, awards and funding of a person at each institution.

    Sums over generated years have closed forms on the clipped span, and the active years are the
    union of span masks, so no year is generated.
    """
    first, last = F.col("first_fiscal_year"), F.col("last_fiscal_year")
    start, end, length = clipped(first, last)
    reported = awards.where(F.col("contact_pi_name").isNotNull() & (length > 0))
    share = annual_share(F.col("total_lifetime_funding"), first, last)
    return reported.groupBy("contact_pi_name", F.col("primary_org").alias("institution")).agg(
        F.min(start).alias("first_year_at_institution"),
        F.max(end).alias("last_year_at_institution"),
        F.bit_count(F.bit_or(span_mask(first, last))).cast("bigint").alias("num_active_years"),
        F.sum(length).alias("total_awards_at_institution"),
        in_units(F.sum(share * length), MILLION).alias("total_funding_millions"),
    )


def collaborations(awards: DataFrame) -> DataFrame:
    """Shared awards per person and collaborator list."""
    first, last = F.col("first_fiscal_year"), F.col("last_fiscal_year")
    shared = awards.where(F.col("is_mpi") & F.col("contact_pi_name").isNotNull() & (first <= last))
    share = annual_share(F.col("total_lifetime_funding"), first, last) * span_length(first, last)
    rows = shared.select(
        F.col("contact_pi_name").alias("pi"),
        F.col("all_pi_names").alias("all_collaborators"),
        "administering_ic", "cluster_label", "first_fiscal_year", "last_fiscal_year",
        share.alias("share"), F.lit("").alias("activity"),
    )
    keys = ["pi", "all_collaborators"]
    totals = (
        rollup(
            rows, keys, "activity", {"money": "share"}, SPAN_LOW, SPAN_HIGH,
            {"units": "administering_ic", "topics": "cluster_label"},
        )
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("num_collaborative_projects"),
            distinct_of("units").alias("num_ics_collaborated"),
            distinct_of("topics").alias("num_topics_collaborated"),
            F.min("first_year").alias("first_collaboration_year"),
            F.max("last_year").alias("latest_collaboration_year"),
            in_units(F.sum("money"), MILLION).alias("total_collaborative_funding_millions"),
        )
    )
    return attached(totals, top_values(rows, keys, {"top_collaboration_topics": ("cluster_label", 5)}), keys)


def award_portfolio(awards: DataFrame) -> DataFrame:
    """Mechanism mix and career milestones per person.

    The reference period ends in 2024; awards that start later never produce a year.
    """
    last = F.least(F.col("last_fiscal_year"), F.lit(LAST_REPORTED))
    rows = awards.where(F.col("contact_pi_name").isNotNull() & (F.col("first_fiscal_year") <= last))
    key = ["contact_pi_name"]
    per_code = rows.groupBy(*key, "activity").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("total_lifetime_funding").alias("funding"),
        F.min("first_fiscal_year").alias("first_year"),
    )
    mix = per_code.groupBy(*key).agg(
        *slice_columns(PORTFOLIO_SLICES, MILLION),
        F.min(F.when(F.expr(m.EARLY_CAREER.sql()), F.col("first_year"))).alias("first_early_career_award"),
        F.min(F.when(F.expr(m.ESTABLISHED.sql()), F.col("first_year"))).alias("first_senior_award"),
    )
    return mix.join(top_values(rows, key, {"top_activity_codes": ("activity", 5)}), key, "left")


def broader_impact(awards: DataFrame) -> DataFrame:
    """Publication totals with typed placeholders for outputs that are not linked yet."""
    return awards.where(F.col("contact_pi_name").isNotNull()).groupBy("contact_pi_name").agg(
        F.sum("publication_count").alias("total_publications"),
        F.lit(None).cast("bigint").alias("patent_count"),
        F.lit(None).cast("string").alias("patent_ids"),
        F.lit(None).cast("bigint").alias("clinical_trial_count"),
        F.lit(None).cast("string").alias("clinical_trial_ids"),
        F.lit(None).cast("string").alias("orcid_id"),
        rounded(ratio(F.sum("publication_count"), F.count("publication_count")), 1).alias("avg_pubs_per_award"),
    )


def complete_cards(awards: DataFrame, limit: int = 1000) -> DataFrame:
    """Full card of the best-funded people.

    The base is reduced to the top ``limit`` people first; every other branch is restricted to them
    by a semi join before its own aggregation; ``limit`` bounds what that join broadcasts.
    """
    key = ["contact_pi_name"]
    known = awards.where(F.col("contact_pi_name").isNotNull())
    per_code = rollup(
        known, key, "activity", MEASURES, SPAN_LOW, SPAN_HIGH,
        {"domains": "domain_id", "topics": "cluster_id", "units": "administering_ic"},
    )
    base = per_code.groupBy(*key).agg(
        F.min("first_year").alias("career_start_year"),
        F.max("last_year").alias("career_last_active_year"),
        F.sum("n").alias("total_awards"),
        in_units(F.sum("funding"), MILLION).alias("total_funding_millions"),
        distinct_of("domains").alias("num_research_domains"),
        distinct_of("topics").alias("num_research_topics"),
        distinct_of("units").alias("num_funding_ics"),
        F.sum("mpi").alias("mpi_awards"),
        percent(F.sum("mpi"), F.sum("n")).alias("pct_collaborative"),
    )
    base = (
        base.where(F.col("total_awards") >= MINIMUM_AWARDS)
        .orderBy(F.desc("total_funding_millions"), *key)
        .limit(limit)
    )
    mine = known.join(F.broadcast(base.select(*key)), key, "left_semi")
    latest = mine.groupBy(*key).agg(
        F.max_by("primary_org", F.struct("last_fiscal_year", "core_project_num")).alias("current_institution")
    )
    tops = top_values(
        mine,
        key,
        {
            "top_research_areas": ("cluster_label", 5),
            "top_domains": ("domain_name", 3),
            "top_funding_ics": ("administering_ic", 3),
        },
    )
    stay = F.struct(
        "first_year_at_institution", "institution", "last_year_at_institution", "num_active_years",
        "total_funding_millions",
    )
    moves = institutional_history(mine).groupBy(*key).agg(
        F.count("institution").alias("num_institutions"),
        F.array_sort(F.collect_list(stay)).alias("institutional_history"),
    )
    shared = collaborations(mine).groupBy(F.col("pi").alias("contact_pi_name")).agg(
        F.sum("num_collaborative_projects").alias("shared_projects"),
        F.sum("total_collaborative_funding_millions").alias("shared_funding"),
    )
    impact = broader_impact(mine).select(
        *key, "total_publications", "avg_pubs_per_award", "patent_count", "clinical_trial_count", "orcid_id"
    )
    return (
        base.join(latest, key, "left")
        .join(tops, key, "left")
        .join(moves, key, "left")
        .join(award_portfolio(mine), key, "left")
        .join(shared, key, "left")
        .join(impact, key, "left")
        .withColumns(
            {
                "num_institutions_worked": F.coalesce("num_institutions", F.lit(1)),
                "collaborative_project_count": F.coalesce("shared_projects", F.lit(0)),
                "collaborative_funding_m": rounded(F.coalesce("shared_funding", F.lit(0.0)), 2),
                "career_span_years": F.col("career_last_active_year") - F.col("career_start_year"),
                "avg_funding_per_award": rounded(ratio(F.col("total_funding_millions"), F.col("total_awards")), 2),
            }
        )
        .drop("num_institutions", "shared_projects", "shared_funding")
    )


def top_people(awards: DataFrame, limit: int = 100) -> DataFrame:
    key = ["contact_pi_name"]
    known = awards.where(F.col("contact_pi_name").isNotNull())
    per_code = rollup(
        known, key, "activity", MEASURES | {"citations": "citation_count"},
        SPAN_LOW | {"organization": "primary_org"}, SPAN_HIGH, {"domains": "domain_id", "topics": "cluster_id"},
    )
    best = (
        per_code.groupBy(*key)
        .agg(
            F.min("organization").alias("primary_institution"),
            F.sum("n").alias("total_awards"),
            in_units(F.sum("funding"), MILLION).alias("funding_millions"),
            F.sum("publications").alias("total_publications"),
            F.sum("citations").alias("total_citations"),
            distinct_of("domains").alias("num_domains"),
            distinct_of("topics").alias("num_topics"),
            F.min("first_year").alias("career_start"),
            F.max("last_year").alias("career_last_active"),
            F.sum("mpi").alias("mpi_awards"),
        )
        .where(F.col("total_awards") >= MINIMUM_AWARDS)
        .orderBy(F.desc("funding_millions"), *key)
        .limit(limit)
    )
    mine = known.join(F.broadcast(best.select(*key)), key, "left_semi")
    tops = top_values(
        mine, key, {"top_research_areas": ("cluster_label", 3), "top_funding_ics": ("administering_ic", 3)}
    )
    return best.join(tops, key, "left").withColumns(
        {
            "avg_citations_per_pub": rounded(ratio(F.col("total_citations"), F.col("total_publications")), 1),
            "career_span_years": F.col("career_last_active") - F.col("career_start"),
            "avg_funding_per_award": rounded(ratio(F.col("funding_millions"), F.col("total_awards")), 2),
            "top_area": F.get("top_research_areas", 0)["value"],
        }
    )

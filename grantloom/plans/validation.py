"""Checks over the source tables and the derived cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantloom.functions.numbers import BILLION, in_units, percent, rounded

EXPECTED_YEARS = (1990, 2024)


def stacked(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def table_counts(projects: DataFrame, abstracts: DataFrame, **others: DataFrame) -> DataFrame:
    """Rows, years and funding of every table, null where a figure does not apply."""

    def years(name: str, rows: DataFrame, year: str) -> DataFrame:
        return rows.agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("total_rows"),
            F.min(F.col(year).cast("int")).alias("min_year"),
            F.max(F.col(year).cast("int")).alias("max_year"),
            F.count_distinct(year).alias("year_count"),
        )

    funding = projects.agg(in_units(F.sum("TOTAL_COST"), BILLION).alias("total_funding_billions"))
    parts = [
        years("projects", projects, "FY").withColumn("total_funding_billions", funding.scalar()),
        years("abstracts", abstracts, "YEAR"),
    ]
    for name, rows in others.items():
        parts.append(rows.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("total_rows")))
    return stacked(*parts)


def projects_by_year(projects: DataFrame) -> DataFrame:
    return projects.groupBy(F.col("FY").cast("int").alias("fiscal_year")).agg(
        F.count(F.lit(1)).alias("project_count"),
        F.count_distinct("CORE_PROJECT_NUM").alias("unique_cores"),
        F.count_distinct("ADMINISTERING_IC").alias("ic_count"),
        in_units(F.sum("TOTAL_COST"), BILLION, 4).alias("funding_billions"),
    )


def abstracts_by_year(abstracts: DataFrame) -> DataFrame:
    return abstracts.groupBy(F.col("YEAR").alias("fiscal_year")).agg(
        F.count(F.lit(1)).alias("abstract_count"), F.count_distinct("APPLICATION_ID").alias("unique_applications")
    )


def missing_years(rows: DataFrame, year: str, first: int = EXPECTED_YEARS[0], last: int = EXPECTED_YEARS[1]) -> DataFrame:
    """Expected years without a row."""
    expected = rows.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("missing_year"))
    present = rows.select(F.col(year).cast("int").alias("missing_year")).distinct()
    return expected.join(present, "missing_year", "left_anti")


def projects_by_unit(projects: DataFrame, limit: int = 30) -> DataFrame:
    return (
        projects.where("ADMINISTERING_IC is not null")
        .groupBy(F.col("ADMINISTERING_IC").alias("ic_code"))
        .agg(
            F.count(F.lit(1)).alias("project_count"),
            in_units(F.sum("TOTAL_COST"), BILLION, 4).alias("funding_billions"),
            F.min(F.col("FY").cast("int")).alias("first_year"),
            F.max(F.col("FY").cast("int")).alias("last_year"),
        )
        .orderBy(F.desc("project_count"), "ic_code")
        .limit(limit)
    )


def null_counts(rows: DataFrame, named: dict[str, str], share_of: str, share_name: str) -> DataFrame:
    """Null count per column (output name to column) and the null share of one column, in one pass."""
    return rows.agg(
        *[F.count_if(F.col(column).isNull()).alias(name) for name, column in named.items()],
        F.count(F.lit(1)).alias("total_rows"),
        percent(F.count_if(F.col(share_of).isNull()), F.count(F.lit(1)), 2).alias(share_name),
    )


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct(key).alias("unique_full_project_nums"),
        (F.count(F.lit(1)) - F.count_distinct(key)).alias("duplicate_count"),
    )


def cost_by_year(projects: DataFrame, limit: int = 10) -> DataFrame:
    """Cost range of the latest years with the exact lower median.

    Costs are counted per (year, cost) before anything is ordered, and the running count that finds
    the median is cut into cost buckets, so a year's rows are never sorted in one task.
    """
    priced = projects.where("TOTAL_COST > 0").select(F.col("FY").cast("int").alias("fiscal_year"), "TOTAL_COST")
    latest = priced.select("fiscal_year").distinct().orderBy(F.desc("fiscal_year")).limit(limit)
    priced = priced.join(F.broadcast(latest), "fiscal_year", "left_semi")
    totals = priced.groupBy("fiscal_year").agg(
        F.count(F.lit(1)).alias("projects_with_cost"),
        F.min("TOTAL_COST").cast("double").alias("min_cost"),
        F.max("TOTAL_COST").cast("double").alias("max_cost"),
        rounded(F.sum("TOTAL_COST").cast("double") / F.count("TOTAL_COST"), 2).alias("avg_cost"),
    )
    return totals.join(grouped_median(priced, "fiscal_year", "TOTAL_COST", "median_cost"), "fiscal_year")


def grouped_median(rows: DataFrame, key: str, value: str, name: str, width: int = 1000) -> DataFrame:
    """Exact lower median per key: the value at rank ``ceil(n / 2)``."""
    counts = rows.groupBy(key, F.floor(F.col(value) / width).alias("bucket"), value).agg(
        F.count(F.lit(1)).alias("n")
    )
    buckets = counts.groupBy(key, "bucket").agg(F.sum("n").alias("size"))
    ordered = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumns(
        {
            "before": F.coalesce(F.sum("size").over(ordered), F.lit(0)),
            "rank": F.ceil(F.sum("size").over(Window.partitionBy(key)) / 2),
        }
    ).where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("size")))
    inside = Window.partitionBy(key).orderBy(value)
    running = F.col("before") + F.sum("n").over(inside)
    return (
        counts.join(placed, [key, "bucket"])
        .withColumn("running", running)
        .where(F.col("running") >= F.col("rank"))
        .groupBy(key)
        .agg(F.min(value).cast("double").alias(name))
    )


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys on each side and in both, tagged and counted in one aggregation."""
    tagged = left.select(F.col(key).alias("key"), F.lit(1).alias("side")).unionByName(
        right.select(F.col(key).alias("key"), F.lit(2).alias("side"))
    )
    sides = tagged.where("key is not null").groupBy("key").agg(F.bit_or("side").alias("sides"))
    return sides.agg(
        F.count_if(F.col("sides").bitwiseAND(1) > 0).alias("total_project_apps"),
        F.count_if(F.col("sides").bitwiseAND(2) > 0).alias("total_abstract_apps"),
        F.count_if(F.col("sides") == 3).alias("matched_apps"),
    ).withColumn("match_percentage", percent(F.col("matched_apps"), F.col("total_project_apps"), 2))


def trial_links(studies: DataFrame) -> DataFrame:
    return studies.agg(
        F.count(F.lit(1)).alias("total_clinical_studies"),
        F.count_distinct("Core_Project_Number").alias("unique_projects_linked"),
        F.count_distinct("ClinicalTrials_gov_ID").alias("unique_trial_ids"),
    )


def card_totals(units: DataFrame, people: DataFrame, organizations: DataFrame, years: DataFrame) -> DataFrame:
    """Cross-check of the cards: entities, awards, funding in billions and a few mechanisms per card type."""

    def line(name: str, rows: DataFrame, awards: str, funding, **more: str | Column) -> DataFrame:
        return rows.agg(
            F.lit(name).alias("card_type"),
            F.count(F.lit(1)).alias("entities"),
            F.sum(awards).alias("awards"),
            rounded(F.sum(funding), 2).alias("funding_billions"),
            *[(F.sum(figure) if isinstance(figure, str) else figure).alias(alias) for alias, figure in more.items()],
        )

    return stacked(
        line("units", units, "total_projects", "total_funding_billions",
             rpg="rpg_standard_count", centers="centers_p_count", training="training_t_count",
             cooperative="coop_agreements_u_count"),
        line("people", people, "total_awards", F.col("total_funding_millions") / 1e3,
             rpg="rpg_awards", centers="center_awards", training="training_awards"),
        line("institutions", organizations, "total_awards", "total_funding_billions",
             rpg="rpg_total", centers="center_total", training="training_total", ctsa="ul1_ctsa_awards", t32="t32_awards",
             rcmi="g12_rcmi_awards"),
        line("years", years, "total_awards", "total_funding_billions",
             rpg="rpg_awards", centers="center_awards", training="training_awards",
             first_year=F.min("fiscal_year"), last_year=F.max("fiscal_year")),
    )


def internal_totals(units: DataFrame, people: DataFrame, organizations: DataFrame) -> DataFrame:
    """Contracts and intramural awards found in each card type."""

    def line(name: str, rows: DataFrame, contracts: str, intramural: str) -> DataFrame:
        return rows.agg(
            F.lit(name).alias("card_type"),
            F.count(F.lit(1)).alias("num_entities"),
            F.sum(contracts).alias("total_contracts"),
            F.sum(intramural).alias("total_intramural"),
        )

    return stacked(
        line("IC Cards", units, "contract_count", "intramural_count"),
        line("PI Cards", people, "contract_awards", "intramural_awards"),
        line("Institution Cards", organizations, "contract_total", "intramural_total"),
    )


def assignment_metrics(assignments: DataFrame) -> DataFrame:
    """Key figures of the second phase as (metric, value) text rows, from one pass."""
    row = assignments.agg(
        F.count(F.lit(1)).alias("Total Records"),
        F.count_distinct("core_project_num").alias("Unique Projects"),
        F.count_distinct("cluster_id").alias("Unique Clusters"),
        F.count_distinct("domain_id").alias("Unique Domains"),
        F.count_if(F.col("cluster_id").isNull()).alias("Null Clusters"),
    )
    return row.unpivot([], row.columns, "metric", "value").withColumn("value", F.col("value").cast("string"))


def assignment_shares(assignments: DataFrame, limit: int = 15) -> DataFrame:
    counts = assignments.groupBy("cluster_id").agg(
        F.min("cluster_label").alias("cluster_label"),
        F.min("domain_name").alias("domain_name"),
        F.count(F.lit(1)).alias("num_awards"),
    )
    total = assignments.agg(F.count(F.lit(1))).scalar()
    return (
        counts.withColumn("pct", percent(F.col("num_awards"), total))
        .orderBy(F.desc("num_awards"), "cluster_id")
        .limit(limit)
    )


def phase_overlap(awards: DataFrame, assignments: DataFrame) -> DataFrame:
    """Awards of each phase and of both; the overlap must be zero."""
    first = awards.where("cluster_id is not null")
    both = key_overlap(assignments, first, "core_project_num")
    row = both.select(
        F.col("total_project_apps").alias("Phase 2 Awards"),
        F.col("total_abstract_apps").alias("Already Clustered (Phase 1)"),
        F.col("matched_apps").alias("Overlap (Should be 0)"),
    )
    return row.unpivot([], row.columns, "metric", "count")


def clustering_status(awards: DataFrame) -> DataFrame:
    clustered = F.count_if(F.col("cluster_id").isNotNull())
    return awards.agg(
        F.lit("Current Status").alias("status"),
        clustered.alias("clustered"),
        F.count_if(F.col("cluster_id").isNull()).alias("unclustered"),
        F.count(F.lit(1)).alias("total"),
        percent(clustered, F.count(F.lit(1))).alias("pct_clustered"),
    )

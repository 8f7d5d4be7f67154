"""Unified grant texts and their statistics; analytical views over linked tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.functions import names
from grantloom.functions.numbers import BILLION, in_units, rounded

MINIMUM_ABSTRACT = 100


def whole_key(rows: DataFrame, name: str = "APPLICATION_ID") -> DataFrame:
    """Casts a floating id to bigint once, so equality joins and text forms agree."""
    return rows.withColumn(name, F.col(name).cast("bigint"))


def grant_texts(projects: DataFrame, abstracts: DataFrame) -> DataFrame:
    """Funded, titled grants with a real abstract and their combined text.

    Abstracts are filtered on length before the join, so short ones are never shuffled.
    """
    usable = whole_key(abstracts).where(F.length("ABSTRACT_TEXT") > MINIMUM_ABSTRACT).drop("YEAR")
    funded = whole_key(projects).where("PROJECT_TITLE is not null and TOTAL_COST > 0")
    joined = funded.join(usable, "APPLICATION_ID")
    return joined.select(
        F.col("APPLICATION_ID").cast("string").alias("APPLICATION_ID"),
        "PROJECT_TITLE",
        F.col("FY").cast("int").alias("FISCAL_YEAR"),
        "IC_NAME",
        F.col("TOTAL_COST").cast("double").alias("TOTAL_COST"),
        "ORG_NAME", "ORG_CITY", "ORG_STATE", "ORG_COUNTRY", "PI_NAMEs", "ABSTRACT_TEXT",
        F.concat("PROJECT_TITLE", F.lit(". "), "ABSTRACT_TEXT").alias("combined_text"),
        (F.length("PROJECT_TITLE") + F.length("ABSTRACT_TEXT")).alias("text_length"),
    )


def table_statistics(projects: DataFrame, abstracts: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows, years and units of each unified table, one row per table."""

    def line(name: str, rows: DataFrame, year: str, unit: str | None) -> DataFrame:
        units = F.count_distinct(unit) if unit else F.lit(None).cast("bigint")
        return rows.agg(
            F.lit(name).alias("table_name"),
            F.count(F.lit(1)).alias("row_count"),
            F.min(F.col(year).cast("int")).alias("min_year"),
            F.max(F.col(year).cast("int")).alias("max_year"),
            units.alias("unique_ics"),
        )

    parts = [
        line("projects_all", projects, "FY", "ADMINISTERING_IC"),
        line("abstracts_all", abstracts, "YEAR", None),
        line("grant_text", texts, "FISCAL_YEAR", "IC_NAME"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def texts_by_year(texts: DataFrame) -> DataFrame:
    return texts.groupBy("FISCAL_YEAR").agg(
        F.count(F.lit(1)).alias("grant_count"),
        in_units(F.sum(F.col("TOTAL_COST").cast("decimal(18,2)")), BILLION, 4).alias("total_funding_billions"),
        rounded(F.avg("text_length"), 0).alias("avg_text_length"),
    )


def texts_by_unit(texts: DataFrame, limit: int = 15) -> DataFrame:
    return (
        texts.groupBy("IC_NAME")
        .agg(
            F.count(F.lit(1)).alias("grant_count"),
            in_units(F.sum(F.col("TOTAL_COST").cast("decimal(18,2)")), BILLION, 4).alias("total_funding_billions"),
        )
        .orderBy(F.desc("grant_count"), "IC_NAME")
        .limit(limit)
    )


def with_abstracts(projects: DataFrame, abstracts: DataFrame) -> DataFrame:
    return whole_key(projects).join(whole_key(abstracts).drop("YEAR"), "APPLICATION_ID", "left")


def with_publications(projects: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct publications per transaction.

    Links are counted per project before the join, so a project's links are not repeated for each of
    its transactions.
    """
    counted = links.groupBy(F.col("PROJECT_NUMBER").alias("CORE_PROJECT_NUM")).agg(
        F.count_distinct("PMID").alias("publications")
    )
    return projects.join(counted, "CORE_PROJECT_NUM", "left").withColumn(
        "publication_count", F.coalesce("publications", F.lit(0))
    ).drop("publications")


def with_trials(projects: DataFrame, studies: DataFrame) -> DataFrame:
    counted = studies.groupBy(F.col("Core_Project_Number").alias("CORE_PROJECT_NUM")).agg(
        F.count_distinct("ClinicalTrials_gov_ID").alias("trials"),
        names.joined_distinct(F.col("Study_Status"), "; ").alias("trial_statuses"),
    )
    return projects.join(counted, "CORE_PROJECT_NUM", "left").withColumn(
        "trial_count", F.coalesce("trials", F.lit(0))
    ).drop("trials")


def register_views(projects: DataFrame, abstracts: DataFrame, links: DataFrame, studies: DataFrame) -> list[str]:
    """The three analytical views as temporary views of the session."""
    views = {
        "grants_with_abstracts": with_abstracts(projects, abstracts),
        "grants_with_publications": with_publications(projects, links),
        "grants_with_clinical_trials": with_trials(projects, studies),
    }
    for name, rows in views.items():
        rows.createOrReplaceTempView(name)
    return list(views)

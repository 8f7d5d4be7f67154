"""Repeatable stratified samples; random order is the md5 order of the row key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantloom.functions.mechanisms import CLUSTERING_ELIGIBLE
from grantloom.functions.numbers import BILLION, digest_number, rounded
from grantloom.functions.years import cost_band, era
from grantloom.operators.ranking import bernoulli, quota_sample, shuffled_head

# Rule-based domains in order of precedence (number, pattern), and their names.
DOMAIN_RULES = (
    (9, "cancer|neoplasm|oncology"),
    (5, "brain|neuro|mental|alzheimer|parkinson"),
    (7, "infectious|hiv|aids|vaccine|immunology"),
    (3, "genetic|genome|biotechnology"),
    (4, "rare disease"),
    (2, "behavioral|social"),
    (10, "bioengineering|device|technology"),
    (1, "clinical trial|prevention"),
    (6, "molecular|cell biology"),
)
OTHER_DOMAIN = 8
DOMAIN_NAMES = (
    "Clinical Trials & Prevention",
    "Behavioral & Social Science",
    "Genetics & Biotechnology",
    "Rare Diseases & Genomics",
    "Neuroscience & Behavior",
    "Molecular Biology & Genomics",
    "Infectious Disease & Immunology",
    "Clinical & Translational Research",
    "Cancer Biology & Oncology",
    "Bioengineering & Technology",
)
TOPICS_PER_DOMAIN = 6
CUT_SALT = "cut:"


def year_unit_share(rows: DataFrame, key: str, share: float = 0.034, size: int = 50_000) -> DataFrame:
    """A fixed share of every (year, unit) stratum, one row at least."""
    quota = F.greatest(F.lit(1.0), F.floor(F.col("group_total") * share + 0.5).cast("double"))
    return _cut(quota_sample(rows, ["FY", "IC_NAME"], key, quota), key, size)


def _cut(kept: DataFrame, key: str, size: int) -> DataFrame:
    """At most ``size`` rows of a stratified sample.

    The cut is a draw of its own, independent of the order inside the strata: rounding up gives small strata
    rows that come last in their order, and a cut in the same order would take just these away again.
    """
    return shuffled_head(kept, key, size, CUT_SALT)


def with_stratum(projects: DataFrame) -> DataFrame:
    """Eligible transactions with their unit, year and cost-band stratum."""
    eligible = projects.where("TOTAL_COST > 0 and FY between 2000 and 2024 and PROJECT_TITLE is not null")
    stratum = F.concat_ws("_", "IC_NAME", F.col("FY").cast("int"), cost_band(F.col("TOTAL_COST")))
    return eligible.withColumn("stratum", stratum)


def proportional(rows: DataFrame, key: str, size: int = 50_000) -> DataFrame:
    """Strata keep their share of the population; every stratum is rounded up."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    target = F.ceil(F.col("group_total") * F.lit(float(size)) / total)
    return _cut(quota_sample(rows, ["stratum"], key, target), key, size)


def year_unit_quota(rows: DataFrame, key: str, size: int = 100_000) -> DataFrame:
    """Proportional quotas per (year, unit) that add up to ``size``.

    Quotas above 95 % of a stratum trigger a cap of 90 %; the capped quotas are rescaled and the rest
    goes to the largest strata.  Quotas are worked out on the strata table, whose size is the number
    of years times the number of units.
    """
    eligible = rows.where("FY between 1990 and 2024 and PROJECT_TITLE is not null and IC_NAME is not null")
    everything = Window.partitionBy(F.lit(1))
    strata = eligible.groupBy("FY", "IC_NAME").agg(F.count(F.lit(1)).alias("n"))
    strata = strata.withColumn("target", F.ceil(F.col("n") / F.sum("n").over(everything) * size).cast("double"))
    rate = F.col("target") / F.col("n")
    strata = strata.withColumn("crowded", F.max(rate).over(everything) > 0.95)
    capped = F.when(F.col("crowded") & (rate > 0.9), F.floor(F.col("n") * 0.9).cast("double")).otherwise(F.col("target"))
    strata = strata.withColumn("target", capped)
    strata = strata.withColumn("target", F.rint(F.col("target") * (F.lit(float(size)) / F.sum("target").over(everything))))
    strata = strata.withColumn("rest", F.lit(float(size)) - F.sum("target").over(everything))
    largest = F.row_number().over(everything.orderBy(F.desc("n"), "FY", "IC_NAME"))
    strata = strata.withColumn("largest", largest)
    extra = F.when(F.col("largest") <= F.abs("rest"), F.signum("rest")).otherwise(0.0)
    quotas = strata.select("FY", "IC_NAME", (F.col("target") + extra).alias("quota"))
    return quota_sample(eligible, ["FY", "IC_NAME"], key, quotas)


def equal_eras(awards: DataFrame, size: int = 250_000) -> DataFrame:
    """The same number of eligible awards from every (unit, era)."""
    eligible = awards.where(
        f"first_fiscal_year >= 2000 and length(project_title) > 20 and {CLUSTERING_ELIGIBLE.sql()}"
    ).withColumn("era", era(F.col("first_fiscal_year")))
    strata = eligible.select("administering_ic", "era").distinct().agg(F.count(F.lit(1)))
    quota = F.floor(F.lit(float(size)) / strata.scalar() + 0.5)
    return _cut(quota_sample(eligible, ["administering_ic", "era"], "core_project_num", quota), "core_project_num", size)


def rule_domain(text: str) -> str:
    """First matching domain of a category text, as a SQL expression."""
    branches = [f"when {text} rlike '(?i){pattern}' then {number}" for number, pattern in DOMAIN_RULES]
    return f"case {' '.join(branches)} else {OTHER_DOMAIN} end"


def rule_based(projects: DataFrame, key: str, percent: int = 5, size: int = 50_000) -> DataFrame:
    """A Bernoulli sample with rule-based domains and hashed topics."""
    eligible = projects.where("TOTAL_COST > 0 and FY between 2000 and 2024 and PROJECT_TITLE is not null")
    sample = shuffled_head(bernoulli(eligible, key, percent), key, size)
    names = F.array(*[F.lit(name) for name in DOMAIN_NAMES])
    return sample.withColumn("domain", F.expr(rule_domain("SPENDING_CATS"))).withColumns(
        {
            "domain_label": F.element_at(names, F.col("domain")),
            "topic": F.col("domain") * TOPICS_PER_DOMAIN
            + digest_number(F.col("PROJECT_TITLE")) % TOPICS_PER_DOMAIN
            + 1,
        }
    )


def domain_totals(sample: DataFrame) -> DataFrame:
    return sample.groupBy("domain", "domain_label").agg(
        F.count(F.lit(1)).alias("grants"), rounded(F.sum("TOTAL_COST") / BILLION, 4).alias("funding_billions")
    )

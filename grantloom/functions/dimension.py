"""The funding-unit dimension and the organisational category rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, name, agency, type, department; the row number is the sort order.
FUNDING_UNITS = (
    ("AA", "National Institute on Alcohol Abuse and Alcoholism", "NIH", "Research IC", "HHS"),
    ("AG", "National Institute on Aging", "NIH", "Research IC", "HHS"),
    ("AI", "National Institute of Allergy and Infectious Diseases", "NIH", "Research IC", "HHS"),
    ("AR", "National Institute of Arthritis and Musculoskeletal and Skin Diseases", "NIH", "Research IC", "HHS"),
    ("AT", "National Center for Advancing Translational Sciences", "NIH", "Research IC", "HHS"),
    ("CA", "National Cancer Institute", "NIH", "Research IC", "HHS"),
    ("DA", "National Institute on Drug Abuse", "NIH", "Research IC", "HHS"),
    ("DC", "National Institute on Deafness and Other Communication Disorders", "NIH", "Research IC", "HHS"),
    ("DE", "National Institute of Dental and Craniofacial Research", "NIH", "Research IC", "HHS"),
    ("DK", "National Institute of Diabetes and Digestive and Kidney Diseases", "NIH", "Research IC", "HHS"),
    ("EB", "National Institute of Biomedical Imaging and Bioengineering", "NIH", "Research IC", "HHS"),
    ("ES", "National Institute of Environmental Health Sciences", "NIH", "Research IC", "HHS"),
    ("EY", "National Eye Institute", "NIH", "Research IC", "HHS"),
    ("GM", "National Institute of General Medical Sciences", "NIH", "Research IC", "HHS"),
    ("HD", "Eunice Kennedy Shriver National Institute of Child Health and Human Development", "NIH", "Research IC", "HHS"),
    ("HG", "National Human Genome Research Institute", "NIH", "Research IC", "HHS"),
    ("HL", "National Heart, Lung, and Blood Institute", "NIH", "Research IC", "HHS"),
    ("LM", "National Library of Medicine", "NIH", "Research IC", "HHS"),
    ("MD", "National Institute on Minority Health and Health Disparities", "NIH", "Research IC", "HHS"),
    ("MH", "National Institute of Mental Health", "NIH", "Research IC", "HHS"),
    ("NR", "National Institute of Nursing Research", "NIH", "Research IC", "HHS"),
    ("NS", "National Institute of Neurological Disorders and Stroke", "NIH", "Research IC", "HHS"),
    ("CC", "NIH Clinical Center", "NIH", "Support IC", "HHS"),
    ("CIT", "Center for Information Technology", "NIH", "Support IC", "HHS"),
    ("CSR", "Center for Scientific Review", "NIH", "Support IC", "HHS"),
    ("FIC", "Fogarty International Center", "NIH", "Support IC", "HHS"),
    ("OD", "Office of the Director", "NIH", "Support IC", "HHS"),
    ("RR", "National Center for Research Resources (Legacy)", "NIH", "Support IC", "HHS"),
    ("RM", "NIH Common Fund", "NIH", "Common Fund", "HHS"),
    ("FDA", "Food and Drug Administration", "FDA", "Regulatory", "HHS"),
    ("FD", "FDA Orphan Products", "FDA", "Regulatory", "HHS"),
    ("CD", "Centers for Disease Control and Prevention", "CDC", "Public Health", "HHS"),
    ("HS", "Agency for Healthcare Research and Quality", "AHRQ", "Health Services", "HHS"),
    ("HR", "Health Resources and Services Administration", "HRSA", "Health Services", "HHS"),
    ("VA", "Department of Veterans Affairs", "VA", "Veterans Health", "VA"),
    ("DOD", "Department of Defense", "DOD", "Defense", "DOD"),
    ("DOE", "Department of Energy", "DOE", "Energy", "DOE"),
    ("NASA", "National Aeronautics and Space Administration", "NASA", "Space", "NASA"),
    ("OH", "Other HHS Agencies", "HHS", "Other", "HHS"),
    ("TR", "Trans-NIH", "NIH", "Trans-NIH", "HHS"),
    ("CK", "Common Fund Keck", "NIH", "Common Fund", "HHS"),
    ("TW", "Fogarty International (Legacy)", "NIH", "Support IC", "HHS"),
    ("TS", "Trans-NIH Special", "NIH", "Trans-NIH", "HHS"),
    ("DD", "NIH Data Discovery", "NIH", "Support IC", "HHS"),
    ("CE", "Common Fund Exceptional Research", "NIH", "Common Fund", "HHS"),
)

# Category shown for each unit type of the central agency.
CENTRAL_AGENCY = "NIH"
CENTRAL_CATEGORIES = {
    "Research IC": "NIH Research",
    "Support IC": "NIH Support",
    "Common Fund": "NIH Common Fund",
    "Trans-NIH": "NIH Trans-IC",
}
OWN_NAME_AGENCIES = ("FDA", "CDC")
OWN_NAME_DEPARTMENTS = ("VA", "DOD", "NASA", "DOE")


def unit_rows() -> list[tuple[str, str, str, str, str, int]]:
    return [(*unit, number) for number, unit in enumerate(FUNDING_UNITS, start=1)]


def funding_units(spark: SparkSession) -> DataFrame:
    schema = "ic_code string, ic_name string, agency string, ic_type string, department string, sort_order int"
    return spark.createDataFrame(unit_rows(), schema)


def organizational_category(agency: Column, ic_type: Column, department: Column) -> Column:
    kinds = F.create_map(*[F.lit(text) for pair in CENTRAL_CATEGORIES.items() for text in pair])
    central = F.when(agency == CENTRAL_AGENCY, F.try_element_at(kinds, ic_type))
    named = F.when(agency.isin(*OWN_NAME_AGENCIES), agency)
    health = F.when(department == "HHS", F.lit("Other HHS"))
    own = F.when(department.isin(*OWN_NAME_DEPARTMENTS), department)
    return F.coalesce(central, named, health, own, F.lit("Other Federal"))


def with_agency(awards: DataFrame) -> DataFrame:
    """Awards enriched with the funding-unit dimension; unmatched codes get ``Unknown``.

    The dimension has a fixed 45 rows, so broadcasting it does not grow with the data.
    """
    dim = F.broadcast(
        funding_units(awards.sparkSession).select(
            F.col("ic_code").alias("administering_ic"),
            F.col("ic_name").alias("dim_name"),
            F.col("agency").alias("dim_agency"),
            F.col("ic_type").alias("dim_type"),
            F.col("department").alias("dim_department"),
        )
    )
    category = organizational_category(F.col("dim_agency"), F.col("dim_type"), F.col("dim_department"))
    return (
        awards.join(dim, "administering_ic", "left")
        .withColumns(
            {
                "organizational_category": category,
                "ic_full_name": F.coalesce("dim_name", F.lit("Unknown IC")),
                "funding_agency": F.coalesce("dim_agency", F.lit("Unknown")),
                "ic_type": F.coalesce("dim_type", F.lit("Unknown")),
                "department": F.coalesce("dim_department", F.lit("Unknown")),
            }
        )
        .drop("dim_name", "dim_agency", "dim_type", "dim_department")
    )

"""File catalog, column profiles and schema exports."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantloom.functions.numbers import percent, rounded

# Columns that mark a dataset kind, in order of precedence.
KIND_MARKERS = (
    ("projects", ("project_title", "core_project_num")),
    ("abstracts", ("abstract_text",)),
    ("publications", ("pmid",)),
    ("patents", ("patent_id",)),
    ("clinical_studies", ("clinicaltrials_gov_id",)),
    ("organizations", ("org_name",)),
)
# Name fragments that mark the role of a column.
COLUMN_ROLES = {
    "id": ("APPLICATION_ID", "APPL_ID", "PROJECT_NUM", "CORE_PROJECT"),
    "title": ("PROJECT_TITLE", "TITLE"),
    "abstract": ("ABSTRACT", "PHR"),
    "fiscal_year": ("FISCAL_YEAR", "FY", "YEAR"),
    "ic": ("IC_NAME", "INSTITUTE", "CENTER", "AGENCY"),
    "cost": ("TOTAL_COST", "AWARD_AMOUNT", "FUNDING"),
}


def dataset_kind(columns: list[str]) -> str:
    found = {name.lower() for name in columns}
    return next((kind for kind, marks in KIND_MARKERS if found & set(marks)), "other")


def column_roles(columns: list[str]) -> dict[str, list[str]]:
    return {
        role: [name for name in columns if any(part in name.upper() for part in parts)]
        for role, parts in COLUMN_ROLES.items()
    }


def file_catalog(tables: dict[str, DataFrame], year_columns: dict[str, str] | None = None) -> DataFrame:
    """Files of each table with rows, bytes, column count, kind and year range.

    ``year_columns`` gives the year expression of the tables that have one.
    """
    year_columns = year_columns or {}
    parts = []
    for name, rows in tables.items():
        kind = dataset_kind(rows.columns)
        year = F.expr(year_columns.get(name, "null"))
        parts.append(
            rows.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"),
                        year.cast("int").alias("year"))
            .groupBy("file", "bytes")
            .agg(
                F.count(F.lit(1)).alias("rows"),
                F.lit(len(rows.columns)).alias("column_count"),
                F.lit(kind).alias("kind"),
                F.min("year").alias("min_year"),
                F.max("year").alias("max_year"),
            )
            .withColumn("table_name", F.lit(name))
        )
    return reduce(DataFrame.unionByName, parts)


def catalog_totals(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("kind").agg(
        F.count(F.lit(1)).alias("files"), F.sum("rows").alias("total_rows"), F.sum("bytes").alias("total_bytes")
    )


def column_profile(rows: DataFrame) -> DataFrame:
    """One row per column: type, non-null count, null share, mean text length.

    All figures come from one aggregation of the table, then the single result row is unpivoted.
    """
    fields = [field for field in rows.schema.fields]
    measures = [F.count(F.lit(1)).alias("total")]
    for position, field in enumerate(fields):
        measures.append(F.count(F.col(field.name)).alias(f"n{position}"))
        length = F.length(F.col(field.name)) if isinstance(field.dataType, T.StringType) else F.lit(None)
        measures.append(F.avg(length).alias(f"l{position}"))
    row = rows.agg(*measures)
    cells = F.array(
        *[
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("dtype"),
                F.col(f"n{position}").alias("non_null"),
                percent(F.col("total") - F.col(f"n{position}"), F.col("total")).alias("null_pct"),
                rounded(F.col(f"l{position}"), 1).alias("avg_length"),
            )
            for position, field in enumerate(fields)
        ]
    )
    return row.select(F.inline(cells))


def key_check(rows: DataFrame, key: str) -> DataFrame:
    """Whether a column is a unique key."""
    return rows.agg(
        F.lit(key).alias("key"),
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct(key).alias("unique_ids"),
        (F.count(F.lit(1)) - F.count_distinct(key)).alias("duplicates"),
    )


def year_distribution(rows: DataFrame, year: str) -> DataFrame:
    return rows.groupBy(F.col(year).cast("int").alias("year")).agg(F.count(F.lit(1)).alias("records"))


def category_columns(tables: dict[str, DataFrame], *patterns: str) -> list[tuple[str, str, str]]:
    """Columns whose name contains one of the patterns, as (table, column, type)."""
    wanted = [pattern.lower() for pattern in patterns]
    return [
        (table, name, kind)
        for table, rows in tables.items()
        for name, kind in rows.dtypes
        if any(pattern in name.lower() for pattern in wanted)
    ]


def tables_like(spark: SparkSession, pattern: str) -> list[str]:
    return sorted(table.name for table in spark.catalog.listTables(pattern=pattern))


def schema_json(rows: DataFrame) -> str:
    """Field names, types and modes as the exported schema document."""
    return json.dumps(
        [
            {
                "name": field.name,
                "type": field.dataType.simpleString().upper(),
                "mode": "NULLABLE" if field.nullable else "REQUIRED",
            }
            for field in rows.schema.fields
        ],
        indent=2,
    )

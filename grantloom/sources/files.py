"""Readers and writers: year folders, drifting schemas, CSV, documents, payloads, snapshots."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantloom.operators.ranking import deduplicated


def year_folders(
    spark: SparkSession, base: str, years: Iterable[int] | None = None, schema: str | T.StructType | None = None
) -> DataFrame:
    """Hive-style ``YEAR=yyyy`` folders.

    With ``years`` only these folders are listed.  With a ``schema`` no footer is opened to plan the read;
    without one the schemas of all files are merged.
    """
    reader = spark.read.option("basePath", base)
    reader = reader.schema(schema) if schema is not None else reader.option("mergeSchema", "true")
    paths = [base] if years is None else [f"{base.rstrip('/')}/YEAR={year}" for year in years]
    return reader.parquet(*paths)


def matching_files(spark: SparkSession, pattern: str) -> DataFrame:
    """All files of a wildcard path as one table; columns are matched by name."""
    return spark.read.option("mergeSchema", "true").parquet(pattern)


def merged_years(parts: dict[int, DataFrame]) -> DataFrame:
    """Year tables under one schema: columns are added, none is dropped."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values())


def conflicting_columns(parts: Iterable[DataFrame]) -> list[str]:
    """Columns that do not have the same type in every part."""
    kinds: dict[str, set[str]] = {}
    for rows in parts:
        for name, kind in rows.dtypes:
            kinds.setdefault(name, set()).add(kind)
    return sorted(name for name, found in kinds.items() if len(found) > 1)


def repaired_years(spark: SparkSession, paths: dict[int, str]) -> tuple[DataFrame, DataFrame]:
    """Reads year files whose types drift.

    A column with different types over the years becomes text.  Returns the rows and a report of the
    loaded and failed years; a file that cannot be read is reported, not fatal.
    """
    parts: dict[int, DataFrame] = {}
    failures: dict[int, str] = {}
    for year, path in paths.items():
        try:
            parts[year] = spark.read.parquet(path)
        except (PySparkException, Py4JJavaError) as error:  # missing or unreadable file: recorded in the report
            failures[year] = str(error).splitlines()[0][:100]
    clash = conflicting_columns(parts.values())
    fixed = {
        year: rows.withColumns({name: F.col(name).cast("string") for name in clash if name in rows.columns})
        for year, rows in parts.items()
    }
    status = [(year, "fixed" if set(clash) & set(parts[year].columns) else "loaded", "") for year in parts]
    status += [(year, "failed", reason) for year, reason in failures.items()]
    report = spark.createDataFrame(sorted(status), "year int, status string, reason string")
    if not fixed:
        raise ValueError("no year could be read")
    return merged_years(fixed), report


def load_years(rows: DataFrame, path: str, year: str = "YEAR") -> None:
    """Writes rows into the folders of their years in one job; a year that is loaded again replaces its folder only."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(year).parquet(path)


def append_years(parts: dict[int, DataFrame], path: str) -> None:
    """Writes years one after the other; the first replaces the table, the rest are appended."""
    for position, (year, rows) in enumerate(sorted(parts.items())):
        mode = "overwrite" if position == 0 else "append"
        rows.withColumn("YEAR", F.lit(year)).write.mode(mode).partitionBy("YEAR").parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header; ``multi_line`` allows line breaks inside quotes, but then a file is one task."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=multi_line, escape='"')


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape='"')


def export(rows: DataFrame, path: str) -> None:
    """Parquet with Snappy compression."""
    rows.write.mode("overwrite").option("compression", "snappy").parquet(path)


def materialized(rows: DataFrame, path: str) -> DataFrame:
    """Writes an intermediate table and reads it back, which also cuts the lineage."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def snapshot(spark: SparkSession, path: str, copy: str) -> DataFrame:
    """Copies a stored table before it is replaced."""
    rows = spark.read.parquet(path)
    return materialized(rows, copy)


POINT_FIELDS = (
    "x double, y double, cluster int, application_id string, title string, ic string, year int, cost double"
)
CLUSTER_FIELDS = (
    "id int, label string, size bigint, top_terms array<string>, top_ic string, ic_count bigint, year_range string, "
    "total_cost double, avg_cost double, center_x double, center_y double"
)
POINTS_DOCUMENT = f"points array<struct<{POINT_FIELDS}>>, clusters array<struct<{CLUSTER_FIELDS}>>"


def read_points_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A ``{points: [...], clusters: [...]}`` document as two tables."""
    document = spark.read.schema(POINTS_DOCUMENT).json(path, multiLine=True)
    return (
        document.select(F.inline("points")),
        document.select(F.inline("clusters")),
    )


def write_points_document(points: DataFrame, clusters: DataFrame, path: str) -> None:
    """Points and clusters as JSON lines in two folders; no part passes through the driver."""
    points.write.mode("overwrite").json(f"{path}/points")
    clusters.write.mode("overwrite").json(f"{path}/clusters")


def read_points_folders(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (
        spark.read.schema(POINT_FIELDS).json(f"{path}/points"),
        spark.read.schema(CLUSTER_FIELDS).json(f"{path}/clusters"),
    )


def point_records(points: DataFrame) -> DataFrame:
    """Points in the document form: short title, text id, zero for a missing cost."""
    return points.select(
        "x", "y", "cluster",
        F.col("application_id").cast("string").alias("application_id"),
        F.coalesce(F.substring("title", 1, 200), F.lit("")).alias("title"),
        "ic",
        F.col("fy").alias("year"),
        F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("cost"),
    )


def flattened(rows: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as plain columns named ``outer.inner``; arrays are kept."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield here

    return rows.select(
        *[F.col(".".join(f"`{part}`" for part in path)).alias(separator.join(path)) for path in leaves(rows.schema, ())]
    )


def payload_table(rows: DataFrame, payload: str, schema: str, key: list[str], order: list[str]) -> DataFrame:
    """Parses a JSON column, flattens it next to the other columns and keeps one row per key."""
    parsed = rows.withColumn("payload", F.from_json(payload, schema)).drop(payload)
    flat = flattened(parsed.select(*[name for name in rows.columns if name != payload], "payload.*"))
    return deduplicated(flat, key, [F.col(name) for name in order])

"""Readers and writers over the given tables: what is written to the shared folder comes back unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantloom.functions.names import funding_split
from grantloom.session import scratch_folder
from grantloom.sources import files, profile
from grantloom.sources import portfolio as source
from grantloom.sources.schemas import STAR_TABLES
from grantloom.streaming import incremental

# A year without a file.
ABSENT = 2999


def csv(spark: SparkSession, root: str) -> DataFrame:
    path = scratch_folder(spark, "csv")
    files.write_csv(source.table(spark, root, "customer"), path)
    return files.read_csv(spark, path, STAR_TABLES["customer"])


def _years(spark: SparkSession, root: str) -> tuple[DataFrame, list[int]]:
    """The projects with their year, and the years of the table: a short list however long the table is."""
    rows = source.projects(spark, root).where("FY is not null").select(
        F.col("APPLICATION_ID").cast("bigint").alias("APPLICATION_ID"), "FULL_PROJECT_NUM", F.col("FY").cast("int").alias("YEAR")
    )
    return rows, sorted(r["YEAR"] for r in rows.select("YEAR").distinct().collect())


def year_folders(spark: SparkSession, root: str) -> DataFrame:
    """All years loaded into one table, the last one twice, and all but the first read back by folder."""
    path = scratch_folder(spark, "years")
    rows, years = _years(spark, root)
    files.load_years(rows, path)
    files.load_years(rows.where(F.col("YEAR") == years[-1]), path)
    return files.year_folders(spark, path, years[1:])


def _drifting(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Year files of which the first has another type, and one is missing."""
    base = scratch_folder(spark, "drift")
    rows, years = _years(spark, root)
    first = F.col("YEAR") == years[0]
    rows.where(first).withColumn("APPLICATION_ID", F.col("APPLICATION_ID").cast("string")).write.partitionBy("YEAR").parquet(base)
    rows.where(~first).write.mode("append").partitionBy("YEAR").parquet(base)
    return files.repaired_years(spark, {year: f"{base}/YEAR={year}" for year in [*years, ABSENT]})


def repaired_years(spark: SparkSession, root: str) -> DataFrame:
    return _drifting(spark, root)[0]


def repaired_year_report(spark: SparkSession, root: str) -> DataFrame:
    return _drifting(spark, root)[1].select("year", "status")


def incremental_cards(spark: SparkSession, root: str) -> DataFrame:
    """Unit cards after the year files have arrived in several batches, one of which is replayed, and were folded in between."""
    base = scratch_folder(spark, "arriving")
    columns = ["ADMINISTERING_IC", "CORE_PROJECT_NUM", "FY", "TOTAL_COST"]
    rows = source.projects(spark, root, "unit").select(*columns)
    schema = incremental.PROJECT_FIELDS
    cards = incremental.CardState(spark, f"{base}/state")
    early = F.coalesce(F.col("FY") < 2008, F.lit(False))
    for number, part in enumerate((rows.where(early), rows.where(~early))):
        part.write.mode("append").parquet(f"{base}/files/part={number}")
        incremental.update_cards(spark, f"{base}/files", schema, cards, f"{base}/checkpoint").awaitTermination()
        if number == 0:
            cards.fold()
    cards.add(spark.read.schema(schema).parquet(f"{base}/files/part=1"), cards.last())  # the same batch again
    return cards.unit_cards()


def wildcard(spark: SparkSession, root: str) -> DataFrame:
    base = scratch_folder(spark, "wild")
    orders = source.table(spark, root, "orders").select("o_orderkey", "o_orderstatus")
    for status in ("F", "O", "P"):
        files.export(orders.where(F.col("o_orderstatus") == status), f"{base}/{'done' if status == 'P' else 'orders'}_{status}")
    return files.matching_files(spark, f"{base}/orders_*")


def points_folders(spark: SparkSession, root: str) -> DataFrame:
    path = scratch_folder(spark, "points")
    clusters = spark.createDataFrame([], files.CLUSTER_FIELDS)
    files.write_points_document(files.point_records(source.points(spark, root)), clusters, path)
    return files.read_points_folders(spark, path)[0]


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """A table is stored, copied, and replaced; the copy keeps the old rows."""
    path, copy = scratch_folder(spark, "table"), scratch_folder(spark, "copy")
    files.materialized(source.table(spark, root, "supplier"), path)
    kept = files.snapshot(spark, path, copy)
    files.materialized(source.table(spark, root, "supplier").limit(0), path)
    return kept


def column_listing(spark: SparkSession, root: str) -> DataFrame:
    """Columns whose names hold a pattern."""
    tables = {name: source.table(spark, root, name) for name in STAR_TABLES}
    found = profile.category_columns(tables, "key", "_id")
    return spark.createDataFrame([x[:2] for x in found], "table_name string, column_name string")


def schema_document(spark: SparkSession, root: str) -> DataFrame:
    """The exported schema of one table, read back as rows."""
    text = profile.schema_json(source.table(spark, root, "lineitem"))
    fields = F.from_json(F.lit(text), "array<struct<name: string, type: string, mode: string>>")
    return spark.range(1).select(F.posexplode(fields).alias("place", "field")).select("place", "field.name", "field.mode")


def funding_splits(spark: SparkSession, root: str) -> DataFrame:
    """Units and amounts of split funding texts."""
    amount = F.col("o_orderkey") * 10
    second = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("\\AI:"), amount + 1)).otherwise("")
    rows = source.table(spark, root, "orders").select("o_orderkey", F.concat(F.lit("CA:"), amount, second).alias("text"))
    split = rows.select("o_orderkey", funding_split(F.col("text")).alias("parts"))
    total = F.aggregate(F.map_values("parts"), F.lit(0.0), lambda a, x: a + x)
    return split.select("o_orderkey", F.size("parts").alias("units"), total.alias("total"), (F.size("parts") > 1).alias("is_split"))


QUERIES = {
    "round_trip_csv": csv,
    "round_trip_year_folders": year_folders,
    "round_trip_repaired_years": repaired_years,
    "repaired_year_report": repaired_year_report,
    "incremental_unit_cards": incremental_cards,
    "round_trip_wildcard": wildcard,
    "round_trip_points_folders": points_folders,
    "round_trip_snapshot": snapshot,
    "column_listing": column_listing,
    "schema_document": schema_document,
    "funding_splits": funding_splits,
}

"""Incremental forms of the year load, of the unit cards and of the centroid assignment.

The batch loads append one year file after the other; as a file stream each new file is picked up once and
appended with the table's schema.  All jobs stop when the files at hand are used up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grantloom.functions.numbers import BILLION, in_units
from grantloom.operators.neighbors import nearest_centroid
from grantloom.session import settled


def append_new_files(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str) -> StreamingQuery:
    """Appends files that arrived under ``folder`` since the last run to the year-partitioned ``table``."""
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)

    def append(batch: DataFrame, number: int) -> None:
        # The batch number names the folder, so a replayed batch replaces its own rows.
        batch.write.mode("overwrite").partitionBy("YEAR").parquet(f"{table}/batch={number}")

    return (
        rows.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def assign_new_points(
    spark: SparkSession, folder: str, schema: str, centroids: DataFrame, target: str, checkpoint: str
) -> StreamingQuery:
    """Gives points arriving as files their nearest existing cluster."""
    points = spark.readStream.schema(schema).parquet(folder)

    def assign(batch: DataFrame, number: int) -> None:
        placed = nearest_centroid(batch, centroids).withColumn("assigned_in", F.lit(number))
        placed.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        points.writeStream.foreachBatch(assign)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


PROJECT_FIELDS = "ADMINISTERING_IC string, CORE_PROJECT_NUM string, FY double, TOTAL_COST decimal(18,2)"
#: What is known of an award within a unit; all of it merges, so any cut of the input into batches gives the same cards.
STATE_FIELDS = "unit string, award string, projects bigint, cost decimal(38,2), first_year int, last_year int"


class CardState:
    """The roll-up behind the unit cards: one row per unit and award, as a folded part and a folder per batch after it.

    A batch is rolled up on its own and written under its number, so a batch that is replayed replaces itself. Distinct
    awards and spans of years are exact, as awards are keys of the state and not counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.batches, self.base = spark, f"{path}/batches", f"{path}/base"
        nothing = spark.createDataFrame([], STATE_FIELDS)
        nothing.write.mode("ignore").parquet(f"{self.base}/upto=-1")
        nothing.write.mode("ignore").parquet(f"{self.batches}/batch=-1")

    def add(self, rows: DataFrame, number: int) -> None:
        rolled = rows.groupBy(F.col("ADMINISTERING_IC").alias("unit"), F.col("CORE_PROJECT_NUM").alias("award")).agg(
            F.count(F.lit(1)).alias("projects"), F.sum("TOTAL_COST").cast("decimal(38,2)").alias("cost"),
            F.min("FY").cast("int").alias("first_year"), F.max("FY").cast("int").alias("last_year"),
        )
        rolled.write.mode("overwrite").parquet(f"{self.batches}/batch={number}")

    def _parts(self) -> DataFrame:
        base = self.spark.read.schema(f"{STATE_FIELDS}, upto int").parquet(self.base)
        upto = base.select("upto").union(self.spark.range(1).select(F.lit(-1))).agg(F.max("upto")).first()[0]
        later = self.spark.read.schema(f"{STATE_FIELDS}, batch int").parquet(self.batches).where(F.col("batch") > upto)
        return base.where(F.col("upto") == upto).drop("upto").unionByName(later.drop("batch"))

    def last(self) -> int:
        """Number of the last batch that has rows."""
        numbers = self.spark.read.schema(f"{STATE_FIELDS}, batch int").parquet(self.batches).agg(F.max("batch")).first()[0]
        return -1 if numbers is None else numbers

    def awards(self) -> DataFrame:
        """The merged state."""
        merged = [F.sum("projects").alias("projects"), F.sum("cost").cast("decimal(38,2)").alias("cost")]
        merged += [F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year")]
        return self._parts().groupBy("unit", "award").agg(*merged)

    def fold(self) -> None:
        """Merges all batches so far into a new base; batches before it are not read any more."""
        last = self.last()
        settled(self.awards()).write.mode("overwrite").parquet(f"{self.base}/upto={last}")

    def unit_cards(self) -> DataFrame:
        return self.awards().groupBy(F.col("unit").alias("administering_ic")).agg(
            F.count("award").alias("awards"), F.sum("projects").alias("projects"), in_units(F.sum("cost"), BILLION, 4).alias("funding_billions"),
            F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"),
        )


def update_cards(spark: SparkSession, folder: str, schema: str, cards: CardState, checkpoint: str) -> StreamingQuery:
    """Rolls files that arrived under ``folder`` since the last run into the cards."""
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    return (
        rows.writeStream.foreachBatch(cards.add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

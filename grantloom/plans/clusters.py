"""Reports over clustered transactions: sizes, lead units, purity, time and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.functions.numbers import ratio, rounded
from grantloom.operators.facets import top_of_counts
from grantloom.operators.ranking import first_rows


def lead_value(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Most frequent value per key; the smallest of tied values, as a mode is read off sorted values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    best = first_rows(counts, [key], [F.desc("n"), F.col("value")], 1)
    return best.select(key, F.col("value").alias(name))


def awards_from_transactions(points: DataFrame) -> DataFrame:
    """One row per application: mean position, total cost, modal unit, first title, latest year."""
    return points.groupBy("application_id").agg(
        rounded(F.avg("x"), 6).alias("umap_x"),
        rounded(F.avg("y"), 6).alias("umap_y"),
        F.sum("cost").cast("double").alias("total_cost"),
        F.expr("mode(ic, true)").alias("ic_name"),
        F.min_by("title", F.struct("fy", "title")).alias("project_title"),
        F.max("fy").alias("fy"),
    )


def summary(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Size, funding, years and lead unit of every cluster."""
    totals = points.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n_grants"),
        rounded(F.sum("cost"), 0).alias("total_funding"),
        rounded(ratio(F.sum("cost"), F.count("cost")), 0).alias("avg_funding"),
        F.min("fy").alias("fy_min"),
        F.max("fy").alias("fy_max"),
    )
    return totals.join(lead_value(points, cluster, "ic", "lead_ic"), cluster, "left")


def largest(points: DataFrame, limit: int = 10) -> DataFrame:
    return (
        points.groupBy("cluster")
        .agg(
            F.count(F.lit(1)).alias("grants"),
            F.count_distinct("ic").alias("unique_ics"),
            F.min("fy").alias("earliest_fy"),
            F.max("fy").alias("latest_fy"),
        )
        .orderBy(F.desc("grants"), "cluster")
        .limit(limit)
    )


def titles_of_largest(points: DataFrame, clusters: int = 3, limit: int = 30) -> DataFrame:
    """Titles of the largest clusters in (cluster, md5) order, ``limit`` in all."""
    top = points.groupBy("cluster").count().orderBy(F.desc("count"), "cluster").limit(clusters)
    wanted = points.join(F.broadcast(top.select("cluster")), "cluster", "left_semi")
    key = F.concat_ws("-", "application_id", "title", "fy", "cost")
    return (
        wanted.select("cluster", F.col("title").alias("project_title"), F.col("ic").alias("ic_name"), "fy", key.alias("key"))
        .orderBy("cluster", F.md5("key"), "key")
        .limit(limit)
        .drop("key")
    )


def unit_purity(points: DataFrame, limit: int = 20) -> DataFrame:
    """Dominant unit and its share for the largest clusters."""
    return (
        purity_of(points, "cluster", "ic")
        .orderBy(F.desc("total_grants"), "cluster")
        .limit(limit)
        .withColumnRenamed("dominant", "dominant_ic")
        .withColumnRenamed("dominant_count", "dominant_ic_count")
        .withColumn("ic_purity", rounded(F.col("purity"), 3))
        .drop("purity")
    )


def purity_of(points: DataFrame, cluster: str, value: str) -> DataFrame:
    """Dominant value of each cluster with its count and share."""
    counts = points.groupBy(cluster, F.col(value).alias("dominant")).agg(F.count(F.lit(1)).alias("dominant_count"))
    sizes = counts.groupBy(cluster).agg(F.sum("dominant_count").alias("total_grants"))
    best = first_rows(counts, [cluster], [F.desc("dominant_count"), F.col("dominant")], 1).drop("place")
    return best.join(sizes, cluster).withColumn("purity", ratio(F.col("dominant_count"), F.col("total_grants")))


def temporal_mix(points: DataFrame, limit: int = 10) -> DataFrame:
    return (
        points.groupBy("cluster")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("fy") >= 2020).alias("recent_2020plus"),
            F.count_if(F.col("fy").between(2015, 2019)).alias("mid_2015_2019"),
            F.count_if(F.col("fy") < 2015).alias("older_pre2015"),
        )
        .withColumn("pct_recent", rounded(ratio(F.col("recent_2020plus"), F.col("total")), 3))
        .orderBy(F.desc("total"), "cluster")
        .limit(limit)
    )


def size_bands(points: DataFrame) -> DataFrame:
    """Number of clusters per size band."""
    sizes = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    band = (
        F.when(F.col("n") < 500, "tiny (<500)")
        .when(F.col("n") < 2000, "small (500-2k)")
        .when(F.col("n") < 4000, "medium (2k-4k)")
        .otherwise("large (4k+)")
    )
    return sizes.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("clusters"))


def size_statistics(points: DataFrame) -> DataFrame:
    """Spread of cluster sizes and of units per cluster."""
    per = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ic").alias("units"))
    return per.agg(
        F.min("n").alias("min_size"),
        F.max("n").alias("max_size"),
        rounded(F.avg("n"), 1).alias("mean_size"),
        F.percentile("n", F.lit(0.5)).alias("median_size"),
        rounded(F.avg("units"), 1).alias("mean_ics"),
        F.max("units").alias("max_ics"),
        F.count_if(F.col("units") > 25).alias("generic_clusters"),
        F.count_if(F.col("n") < 100).alias("small_clusters"),
    )


def coverage_bands(points: DataFrame) -> DataFrame:
    """Clusters by number of units and by years spanned."""
    per = points.groupBy("cluster").agg(
        F.count_distinct("ic").alias("units"), (F.max("fy") - F.min("fy")).alias("span")
    )
    return per.agg(
        F.count_if(F.col("units") == 1).alias("ics_1"),
        F.count_if(F.col("units").between(2, 5)).alias("ics_2_5"),
        F.count_if(F.col("units").between(6, 10)).alias("ics_6_10"),
        F.count_if(F.col("units") > 10).alias("ics_over_10"),
        F.count_if(F.col("span") < 10).alias("span_under_10"),
        F.count_if(F.col("span").between(10, 19)).alias("span_10_20"),
        F.count_if(F.col("span") >= 20).alias("span_20_up"),
    )


def unit_crosstab(points: DataFrame, units: int = 15, clusters: int = 20) -> DataFrame:
    """Grants of the largest units in the largest clusters, one column per cluster.

    The pivot columns are the ``clusters`` largest, named by their rank, so the width is fixed.
    """
    pairs = points.groupBy("ic", "cluster").agg(F.count(F.lit(1)).alias("n"))
    tops = pairs.groupBy("cluster").agg(F.sum("n").alias("size")).orderBy(F.desc("size"), "cluster").limit(clusters)
    heads = pairs.groupBy("ic").agg(F.sum("n").alias("size")).orderBy(F.desc("size"), "ic").limit(units)
    from pyspark.sql import Window

    ranked = tops.withColumn(
        "rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("size"), "cluster"))
    )
    table = pairs.join(F.broadcast(ranked.select("cluster", "rank")), "cluster").join(
        F.broadcast(heads.select("ic")), "ic", "left_semi"
    )
    names = [f"c{rank:02d}" for rank in range(1, clusters + 1)]
    named = table.withColumn("column", F.format_string("c%02d", F.col("rank")))
    return named.groupBy("ic").pivot("column", names).agg(F.sum("n")).fillna(0)


def sample_titles(points: DataFrame, clusters: int = 10, titles: int = 10) -> DataFrame:
    """Titles in md5 order for manual review of the largest clusters, with their lead unit."""
    sizes = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("ic").alias("ics"))
    top = sizes.orderBy(F.desc("size"), "cluster").limit(clusters)
    rows = points.join(F.broadcast(top), "cluster").withColumn(
        "key", F.concat_ws("-", "application_id", "title", "fy", "cost")
    )
    picked = first_rows(rows, ["cluster"], [F.md5("key"), F.col("key")], titles)
    leads = lead_value(points, "cluster", "ic", "top_ic")
    return picked.join(leads, "cluster", "left").select(
        "cluster", "size", "ics", "top_ic", "place", F.substring("title", 1, 100).alias("title")
    )


def unit_lists(points: DataFrame, k: int = 3) -> DataFrame:
    counts = points.groupBy("topic", F.col("ic").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return top_of_counts(counts.withColumn("facet", F.lit("top_ics")), ["topic"], {"top_ics": k})

"""Quality of a clustering: separation, agreement, purity and composite scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantloom.functions.numbers import ratio, rounded
from grantloom.operators.facets import shown, top_of_counts
from grantloom.plans.clusters import purity_of


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap)


def silhouette(rows: DataFrame, vector: str, label: str, measure: str = "squaredEuclidean") -> float:
    """Silhouette from cluster sums, so no pair of rows is compared.

    ``vector`` is an array column.  Squared Euclidean or cosine distances; values differ from those
    with plain Euclidean distance.
    """
    data = rows.select(array_to_vector(vector).alias("features"), F.col(label).cast("double").alias("prediction"))
    return ClusteringEvaluator(distanceMeasure=measure).evaluate(data)


def _centres(rows: DataFrame, vector: str, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).alias("id")).agg(
        F.count(F.lit(1)).alias("size"),
        vector_to_array(Summarizer.mean(array_to_vector(vector))).alias("centre"),
    )


def separation(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin scores.

    One pass gives the centres; they enter the second pass as a scalar subquery, whose size is clusters
    times dimensions.  Distances are averaged per cluster with map-side combine; pairs of centres are
    compared inside that array.
    """
    centres = _centres(rows, vector, label)
    packed = centres.agg(F.array_sort(F.collect_list(F.struct("id", "size", "centre")))).scalar()
    spread = (
        rows.select(F.col(label).alias("id"), F.col(vector).alias("v"))
        .withColumn("cells", packed)
        .withColumn("own", F.get(F.filter("cells", lambda cell: cell["id"] == F.col("id")), 0)["centre"])
        .withColumn("gap", squared_distance(F.col("v"), F.col("own")))
        .groupBy("id")
        .agg(F.sum("gap").alias("within"), F.avg(F.sqrt("gap")).alias("scatter"))
    )
    table = centres.join(spread, "id")
    all_cells = table.agg(
        F.array_sort(F.collect_list(F.struct("id", "size", "centre", "within", "scatter"))).alias("cells"),
        F.sum("size").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum("within").alias("within"),
    )
    overall = rows.agg(vector_to_array(Summarizer.mean(array_to_vector(vector)))).scalar()

    def between(total: Column, cell: Column) -> Column:
        return total + cell["size"] * squared_distance(cell["centre"], F.col("overall"))

    def worst(cell: Column) -> Column:
        others = F.filter("cells", lambda other: other["id"] != cell["id"])
        return F.array_max(
            F.transform(
                others,
                lambda other: (cell["scatter"] + other["scatter"])
                / F.sqrt(squared_distance(cell["centre"], other["centre"])),
            )
        )

    scored = all_cells.withColumn("overall", overall).withColumns(
        {
            "between": F.aggregate("cells", F.lit(0.0), between),
            "worst": F.aggregate(F.transform("cells", worst), F.lit(0.0), lambda total, value: total + value),
        }
    )
    return scored.select(
        "k",
        "n",
        rounded((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k"))), 6).alias(
            "calinski_harabasz"
        ),
        rounded(F.col("worst") / F.col("k"), 6).alias("davies_bouldin"),
    )


def adjusted_rand(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency table."""
    table = rows.groupBy(F.col(left).alias("a"), F.col(right).alias("b")).agg(F.count(F.lit(1)).alias("n"))

    def pairs(counts: DataFrame) -> Column:
        n = F.col("n").cast("double")
        return counts.agg(F.sum(n * (n - 1) / 2)).scalar()

    both = pairs(table)
    by_left = pairs(table.groupBy("a").agg(F.sum("n").alias("n")))
    by_right = pairs(table.groupBy("b").agg(F.sum("n").alias("n")))
    total = table.agg(F.sum("n").cast("double").alias("n")).withColumns({"ij": both, "i": by_left, "j": by_right})
    everything = F.col("n") * (F.col("n") - 1) / 2
    expected = F.col("i") * F.col("j") / everything
    best = (F.col("i") + F.col("j")) / 2
    return total.select(rounded((F.col("ij") - expected) / (best - expected), 6).alias("adjusted_rand"))


def mean_purity(points: DataFrame, cluster: str, value: str) -> DataFrame:
    """Mean purity over clusters next to the purity of a random assignment."""
    kinds = points.agg(F.count_distinct(value)).scalar()
    return purity_of(points, cluster, value).agg(
        F.count(F.lit(1)).alias("clusters"), rounded(F.avg("purity"), 6).alias("mean_purity")
    ).withColumn("random_baseline", rounded(F.lit(1.0) / kinds, 6))


def fit_quality(rows: DataFrame, near: float, share: float) -> dict[str, Column]:
    """Whether at least ``near`` of the rows lie nearest to the mean of their own ``cluster``, and whether at most ``share`` of the
    squared distance to the mean of all rows is left within clusters. ``rows`` has ``(vector, cluster)``.
    """
    means = _centres(rows, "vector", "cluster").where("id is not null").orderBy("id").collect()  # clusters x coordinates
    ids, centres = [r["id"] for r in means], np.array([r["centre"] for r in means])
    overall = np.average(centres, axis=0, weights=[r["size"] for r in means]) if means else np.zeros(0)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                matrix = np.stack(batch["vector"].to_numpy()).astype(np.float64)
                gaps = (matrix**2).sum(axis=1)[:, None] - 2 * matrix @ centres.T + (centres**2).sum(axis=1)[None, :]
                own = gaps[np.arange(len(matrix)), np.searchsorted(ids, batch["cluster"].to_numpy())]
                right = int((own <= gaps.min(axis=1) + 1e-9).sum())
                yield pd.DataFrame({"n": [len(matrix)], "right": [right], "within": [np.maximum(own, 0.0).sum()], "whole": [((matrix - overall) ** 2).sum()]})

    parts = rows.where("cluster is not null").select("vector", "cluster")
    found = parts.mapInPandas(measure, "n bigint, right bigint, within double, whole double")
    n, right, within, whole = found.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "right", "within", "whole"))).first()
    return {"near_means": F.lit(bool(n and right >= near * n)), "cost_below": F.lit(bool(whole and within <= share * whole))}


def fixed_composite(rows: DataFrame) -> DataFrame:
    """Weighted composite of the five scores of a candidate."""
    half = lambda name: (F.col(name) + 1) / 2
    score = (
        0.3 * half("silhouette_combined")
        + 0.2 * half("silhouette_semantic")
        + 0.2 * F.least(F.col("calinski_harabasz") / 1000, F.lit(1.0))
        + 0.15 * F.col("ic_homogeneity")
        + 0.15 * (1 - F.least(F.col("davies_bouldin") / 5, F.lit(1.0)))
    )
    return rows.withColumn("composite_score", score)


def min_max_composite(rows: DataFrame) -> DataFrame:
    """Mean of the min-max scaled scores over all candidates; Davies-Bouldin counts inversely."""
    bounds = rows.agg(
        *[f(name).alias(f"{label}_{name}") for name in ("silhouette", "calinski_harabasz", "davies_bouldin")
          for label, f in (("low", F.min), ("high", F.max))]
    )
    row = bounds.agg(F.first(F.struct("*"))).scalar()
    joined = rows.withColumn("bounds", row)

    def scaled(name: str) -> Column:
        low, high = F.col(f"bounds.low_{name}"), F.col(f"bounds.high_{name}")
        return (F.col(name) - low) / (high - low + 1e-10)

    score = (scaled("silhouette") + scaled("calinski_harabasz") + 1 - scaled("davies_bouldin")) / 3
    return joined.withColumn("composite", score).drop("bounds")


# Candidates looked at for structures of two and of three levels.
TWO_LEVEL_CANDIDATES, THREE_LEVEL_CANDIDATES = 5, 3


def hierarchy_preference(candidates: DataFrame) -> DataFrame:
    """Scores of two- and three-level structures built on a first level of ``n_clusters``.

    Two levels look at the five candidates of highest silhouette and take those of 5 to 12 clusters, three
    levels look at the first three and take those of 5 to 10.
    """
    best = lambda low, high, n: candidates.orderBy(F.desc("silhouette"), "name").limit(n).where(
        F.col("n_clusters").between(low, high)
    )
    two = best(5, 12, TWO_LEVEL_CANDIDATES).select(
        F.lit("2-level").alias("structure"), "name", "n_clusters", (F.col("n_clusters") * 6).alias("leaves"),
        (F.col("silhouette") * (1 - F.abs(F.col("n_clusters") * 6 - 60) / 100)).alias("score"),
    )
    three = best(5, 10, THREE_LEVEL_CANDIDATES).select(
        F.lit("3-level").alias("structure"), "name", "n_clusters", (F.col("n_clusters") * 15).alias("leaves"),
        (F.col("silhouette") * (1 - F.abs(F.col("n_clusters") * 15 - 100) / 200)).alias("score"),
    )
    return two.unionByName(three)


def _gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum of outer products and of unit vectors of one partition, one output row per dimension."""
    total = sums = None
    count = 0
    for batch in batches:
        if batch.empty:
            continue
        matrix = np.stack(batch["v"].to_numpy()).astype(np.float64)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = matrix / np.where(norms == 0, 1.0, norms)
        total = matrix.T @ matrix if total is None else total + matrix.T @ matrix
        sums = matrix.sum(axis=0) if sums is None else sums + matrix.sum(axis=0)
        count += len(matrix)
    if count:
        yield pd.DataFrame(
            {"dim": np.arange(len(sums)), "products": list(total), "sum": sums, "n": np.full(len(sums), count)}
        )


def pairwise_variation(rows: DataFrame, vector: str) -> DataFrame:
    """Mean, deviation and coefficient of variation of all pairwise cosine distances.

    First and second moments of the similarities follow from the sum of the unit vectors and from the
    sum of their outer products, so all rows are covered without forming a pair.
    """
    parts = rows.select(F.col(vector).alias("v")).mapInPandas(
        _gram, "dim int, products array<double>, sum double, n bigint"
    )
    per_dim = parts.groupBy("dim").agg(
        vector_to_array(Summarizer.sum(array_to_vector("products"))).alias("products"),
        F.sum("sum").alias("sum"),
        F.sum("n").alias("n"),
    )
    squares = F.aggregate("products", F.lit(0.0), lambda total, value: total + value * value)
    moments = per_dim.select("n", (F.col("sum") * F.col("sum")).alias("s1"), squares.alias("s2")).agg(
        F.max("n").cast("double").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")
    )
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean_similarity = (F.col("s1") - F.col("n")) / 2 / F.col("pairs")
    square_mean = (F.col("s2") - F.col("n")) / 2 / F.col("pairs")
    stats = moments.withColumn("pairs", pairs).select(
        F.col("pairs").cast("bigint").alias("pairs"),
        (1 - mean_similarity).alias("mean"),
        F.sqrt(square_mean - mean_similarity * mean_similarity).alias("std"),
    )
    return stats.select(
        "pairs", rounded(F.col("mean"), 6).alias("mean"), rounded(F.col("std"), 6).alias("std"),
        rounded(F.col("std") / F.col("mean"), 6).alias("cv"),
    )


def topic_scores(points: DataFrame) -> DataFrame:
    """Size, unit diversity and penalty score of each topic; a higher score is worse."""
    counts = points.groupBy("topic", F.col("ic").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), F.count("cost").alias("priced"),
        F.min("fy").alias("low"), F.max("fy").alias("high"),
    )
    totals = counts.groupBy("topic").agg(
        F.sum("n").alias("n_grants"),
        F.count(F.lit(1)).alias("n_ics"),
        F.sum((F.col("n") * F.col("n")).cast("double")).alias("squares"),
        (F.max("high") - F.min("low")).alias("year_span"),
        rounded(ratio(F.sum("cost"), F.sum("priced")), 2).alias("avg_funding"),
    )
    n, units = F.col("n_grants"), F.col("n_ics")
    score = F.when(n < 100, 100).otherwise(0) + F.when(units > 25, units).otherwise(0) + F.when(n == 1, 1000).otherwise(0)
    scored = totals.select(
        "topic", "n_grants", "n_ics",
        (-rounded(F.col("squares") / (n * n).cast("double"), 6)).alias("neg_hhi"),
        "year_span", "avg_funding", score.cast("bigint").alias("quality_score"),
    )
    tops = top_of_counts(
        counts.select("topic", "value", "n").withColumn("facet", F.lit("top_3_ics")), ["topic"], {"top_3_ics": 3}
    )
    return scored.join(tops.withColumn("top_3_ics", shown("top_3_ics")), "topic", "left")


def size_diversity(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Clusters that are small (under 100 rows) or generic (over 25 units)."""
    per = points.groupBy(cluster, "ic").agg(F.count(F.lit(1)).alias("n")).groupBy(cluster).agg(
        F.sum("n").alias("size"), F.count(F.lit(1)).alias("units")
    )
    return per.select(
        cluster, "size", "units", (F.col("size") < 100).alias("is_small"), (F.col("units") > 25).alias("is_generic")
    )


def spread(points: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Range and aspect of the map and the mean variance inside clusters.

    The variance of a cluster is taken over both coordinates together.
    """
    coordinates = points.select(cluster, F.explode(F.array("x", "y")).alias("value"))
    within = (
        coordinates.groupBy(cluster)
        .agg(F.var_pop("value").alias("variance"), F.count(F.lit(1)).alias("n"))
        .agg(F.sum(F.when(F.col("n") > 2, F.col("variance")).otherwise(0.0)) / F.count(F.lit(1)))
        .scalar()
    )
    extent = points.agg((F.max("x") - F.min("x")).alias("x_range"), (F.max("y") - F.min("y")).alias("y_range"))
    aspect = F.when(F.col("y_range") > 0, F.col("x_range") / F.col("y_range")).otherwise(1.0)
    return extent.withColumns(
        {"aspect_ratio": rounded(aspect, 6), "within_cluster_variance": rounded(within, 6)}
    )


def nesting(points: DataFrame) -> DataFrame:
    """Flat clusters found in each domain."""
    return points.groupBy("domain", "domain_label").agg(
        F.count_distinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("grants")
    )

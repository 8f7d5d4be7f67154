"""Assigning unclustered awards to existing clusters, and merging both phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantloom.functions.numbers import BILLION, in_units, percent, ratio, rounded
from grantloom.operators.facets import attached, top_of_counts
from grantloom.operators.neighbors import cosine_neighbors, nearest_centroid
from grantloom.operators.ranking import first_rows

# Defaults of the unit heuristic and neighbour count.
UNMAPPED = {"cluster_id": 74, "cluster_label": "Unmapped", "domain_id": "D99_UNMAPPED", "domain_name": "Unmapped"}
HEURISTIC = "IC-based heuristic"
NEIGHBORS = 10
CLUSTER_COLUMNS = ("cluster_id", "cluster_label", "domain_id", "domain_name", "umap_x", "umap_y")


def unclustered_extract(awards: DataFrame) -> DataFrame:
    """Titled awards without a cluster, with the text their vectors are made from."""
    blank = F.lit("")
    text = F.concat(
        F.coalesce("project_title", blank), F.lit(" "),
        F.coalesce("project_terms", blank), F.lit(" "),
        F.coalesce("spending_categories", blank),
    )
    return awards.where("cluster_id is null and project_title is not null").select(
        "core_project_num", "administering_ic", "organizational_category", "project_title", "project_terms",
        "spending_categories", text.alias("combined_text"),
        F.col("total_lifetime_funding").cast("double").alias("total_lifetime_funding"),
        "publication_count", "first_fiscal_year", "last_fiscal_year", "activity", "is_mpi", "pi_count",
    )


def centroids(awards: DataFrame) -> DataFrame:
    known = awards.where("cluster_id is not null")
    return known.groupBy("cluster_id", "cluster_label", "domain_id", "domain_name").agg(
        rounded(F.avg("umap_x"), 6).alias("centroid_x"), rounded(F.avg("umap_y"), 6).alias("centroid_y")
    )


def by_unit_heuristic(awards: DataFrame) -> DataFrame:
    """Gives an unclustered award the most common cluster of its funding unit."""
    groups = ["cluster_id", "cluster_label", "domain_id", "domain_name"]
    sizes = (
        awards.where("cluster_id is not null")
        .groupBy("administering_ic", *groups)
        .agg(
            F.count(F.lit(1)).alias("ic_cluster_size"),
            rounded(F.avg("umap_x"), 4).alias("umap_x"),
            rounded(F.avg("umap_y"), 4).alias("umap_y"),
        )
    )
    order = [F.desc("ic_cluster_size"), F.col("cluster_id"), F.col("domain_id")]
    common = first_rows(sizes, ["administering_ic"], order, 1).drop("place")
    # One row per funding unit: broadcasting it keeps a unit with a third of the awards in place.
    joined = awards.where("cluster_id is null").select("core_project_num", "administering_ic").join(
        F.broadcast(common), "administering_ic", "left"
    )
    return joined.select(
        "core_project_num",
        *[F.coalesce(F.col(name), F.lit(default)).alias(name) for name, default in UNMAPPED.items()],
        F.coalesce("umap_x", F.lit(0.0)).alias("umap_x"),
        F.coalesce("umap_y", F.lit(0.0)).alias("umap_y"),
        "ic_cluster_size",
        F.lit(HEURISTIC).alias("assignment_method"),
    )


def cluster_names(awards: DataFrame) -> DataFrame:
    """Label and domain of every first-phase cluster: those of most of its awards."""
    columns = ["cluster_label", "domain_id", "domain_name"]
    counts = awards.where("cluster_id is not null").groupBy("cluster_id", *columns).agg(F.count(F.lit(1)).alias("n"))
    return first_rows(counts, ["cluster_id"], [F.desc("n"), *(F.col(c) for c in columns)], 1).select("cluster_id", *columns)


def named(assigned: DataFrame, names: DataFrame) -> DataFrame:
    """Adds label and domain; clusters without a name keep their assignment and are marked unmapped."""
    joined = assigned.join(names, "cluster_id", "left")
    return joined.withColumns(
        {name: F.coalesce(name, F.lit(UNMAPPED[name])) for name in ("cluster_label", "domain_id", "domain_name")}
    )


def by_neighbors(new: DataFrame, reference: DataFrame, k: int = NEIGHBORS) -> DataFrame:
    """Places new vectors at the mean position of their nearest clustered vectors and assigns the
    nearest cluster centre.

    Both inputs have ``(vec_id, embedding)``; the reference also ``(x, y, cluster_id)``.
    """
    found = cosine_neighbors(
        new.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
        reference.select(F.col("vec_id").alias("reference_id"), F.col("embedding").alias("vector")),
        k,
    )
    places = found.join(
        reference.select(F.col("vec_id").alias("reference_id"), "x", "y"), "reference_id"
    ).groupBy(F.col("query_id").alias("vec_id")).agg(rounded(F.avg("x"), 6).alias("x"), rounded(F.avg("y"), 6).alias("y"))
    centers = reference.groupBy("cluster_id").agg(
        rounded(F.avg("x"), 6).alias("centroid_x"), rounded(F.avg("y"), 6).alias("centroid_y")
    )
    assigned = nearest_centroid(places, centers)
    return assigned.withColumn("cluster_distance", rounded(F.col("cluster_distance"), 6))


def merged_cards(awards: DataFrame, assignments: DataFrame, prefer: str = "existing", method: str | None = None) -> DataFrame:
    """Awards with cluster columns filled from the assignments.

    ``prefer='existing'`` keeps first-phase values where present; ``prefer='assigned'`` lets the second
    phase win.  ``clustering_phase`` tells where a value came from.
    """
    given = assignments.select(
        F.col("core_project_num"), *[F.col(name).alias(f"p_{name}") for name in CLUSTER_COLUMNS]
    )
    joined = awards.join(given, "core_project_num", "left")
    suffix = f" ({method})" if method else ""
    first = F.col("cluster_id").isNotNull()
    second = F.col("p_cluster_id").isNotNull()
    if prefer == "existing":
        phase = F.when(first, "Phase 1 (ML)" if method else "Phase 1").when(second, f"Phase 2{suffix}")
        merged = {name: F.coalesce(name, f"p_{name}") for name in CLUSTER_COLUMNS}
    else:
        phase = F.when(second, f"Phase 2{suffix}").when(first, "Phase 1")
        merged = {name: F.coalesce(f"p_{name}", name) for name in CLUSTER_COLUMNS}
    return (
        joined.withColumns({"clustering_phase": phase.otherwise("Unclustered"), "is_clustered": first | second})
        .withColumns(merged)
        .drop(*[f"p_{name}" for name in CLUSTER_COLUMNS])
    )


def phase_coverage(cards: DataFrame) -> DataFrame:
    """Awards, funding and share of each clustering phase."""
    totals = cards.groupBy("clustering_phase").agg(
        F.count(F.lit(1)).alias("num_awards"),
        in_units(F.sum("total_lifetime_funding"), BILLION).alias("funding_billions"),
        F.count_distinct("administering_ic").alias("num_ics"),
        F.count_distinct("domain_id").alias("num_domains"),
        F.count_distinct("cluster_id").alias("num_clusters"),
    )
    # Three rows at most: the window over everything is over this aggregate.
    whole = Window.partitionBy(F.lit(1))
    return totals.withColumn("pct_total", percent(F.col("num_awards"), F.sum("num_awards").over(whole)))


def domain_summary(cards: DataFrame) -> DataFrame:
    return cards.where("is_clustered").groupBy("domain_id", "domain_name", "is_research_topic").agg(
        F.count(F.lit(1)).alias("num_awards"),
        in_units(F.sum("total_lifetime_funding"), BILLION).alias("funding_billions"),
        rounded(ratio(F.sum("publication_count"), F.count("publication_count")), 1).alias("avg_pubs"),
        rounded(ratio(F.sum("pi_count"), F.count("pi_count")), 2).alias("avg_pi_count"),
        F.count_if("is_mpi").alias("mpi_awards"),
        percent(F.count_if("is_mpi"), F.count(F.lit(1))).alias("pct_mpi"),
        F.count_if(F.col("clustering_phase") == "Phase 1").alias("phase1_awards"),
        F.count_if(F.col("clustering_phase") == "Phase 2").alias("phase2_awards"),
        F.min("first_fiscal_year").alias("earliest_year"),
        F.max("last_fiscal_year").alias("latest_year"),
    )


def cluster_summary(cards: DataFrame) -> DataFrame:
    keys = ["domain_id", "domain_name", "cluster_id", "cluster_label"]
    per_unit = cards.where("is_clustered").groupBy(*keys, "administering_ic").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("total_lifetime_funding").alias("funding"),
        F.sum("publication_count").alias("publications"),
        F.count("publication_count").alias("with_publications"),
        F.count_if(F.col("clustering_phase") == "Phase 1").alias("first"),
        F.count_if(F.col("clustering_phase") == "Phase 2").alias("second"),
        F.sum("umap_x").alias("sx"),
        F.sum("umap_y").alias("sy"),
    )
    totals = per_unit.groupBy(*keys).agg(
        F.sum("n").alias("num_awards"),
        in_units(F.sum("funding"), BILLION).alias("funding_billions"),
        rounded(ratio(F.sum("publications"), F.sum("with_publications")), 1).alias("avg_pubs"),
        F.sum("first").alias("phase1_awards"),
        F.sum("second").alias("phase2_awards"),
        rounded(F.sum("sx") / F.sum("n"), 4).alias("centroid_x"),
        rounded(F.sum("sy") / F.sum("n"), 4).alias("centroid_y"),
    )
    counts = per_unit.where("administering_ic is not null").select(
        *keys, F.lit("top_ics").alias("facet"), F.col("administering_ic").alias("value"), "n"
    )
    return attached(totals, top_of_counts(counts, keys, {"top_ics": 5}), keys)

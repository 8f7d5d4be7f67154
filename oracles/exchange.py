"""Oracles of the round trips and of facts that any right clustering has."""

from oracles.base import rnd, with_base
from oracles.checks import SQL as CHECKS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
IN_TABLES = ", ".join(f"'{name}'" for name in TABLES)

FITTED = "SELECT count(*) AS rows, 0::BIGINT AS unlabelled, {1}::BIGINT AS labels, true AS near_means, true AS cost_below FROM {0}"

SQL = {
    "round_trip_csv": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "round_trip_year_folders": with_base(
        """SELECT application_id::BIGINT AS "APPLICATION_ID", full_project_num AS "FULL_PROJECT_NUM", fy::INTEGER AS "YEAR"
FROM project WHERE fy > (SELECT min(fy) FROM project)"""
    ),
    "round_trip_repaired_years": with_base(
        """SELECT application_id::BIGINT::VARCHAR AS "APPLICATION_ID", full_project_num AS "FULL_PROJECT_NUM"
FROM project WHERE fy IS NOT NULL"""
    ),
    "repaired_year_report": with_base(
        """SELECT DISTINCT fy::INTEGER AS year, 'fixed' AS status FROM project WHERE fy IS NOT NULL UNION ALL SELECT 2999, 'failed'"""
    ),
    "incremental_unit_cards": with_base(
        f"""SELECT administering_ic, count(DISTINCT core_project_num) AS awards, count(*) AS projects,
  {rnd('sum(total_cost)::DOUBLE / 1e9::DOUBLE', 4)} AS funding_billions, min(fy)::INTEGER AS first_year, max(fy)::INTEGER AS last_year
FROM project GROUP BY 1"""
    ),
    "round_trip_wildcard": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')",
    "round_trip_points_folders": CHECKS["point_records"],
    "round_trip_snapshot": "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
    "column_listing": f"""SELECT table_name, column_name FROM information_schema.columns
WHERE table_name IN ({IN_TABLES}) AND (contains(lower(column_name), 'key') OR contains(lower(column_name), '_id'))""",
    "schema_document": """SELECT (ordinal_position - 1)::INTEGER AS place, column_name AS name, 'NULLABLE' AS mode
FROM information_schema.columns WHERE table_name = 'lineitem'""",
    "funding_splits": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END::INTEGER AS units,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 20 + 1 ELSE o_orderkey * 10 END::DOUBLE AS total,
  o_orderkey % 3 = 0 AS is_split FROM orders""",
    "vector_hierarchy_facts": "SELECT count(*) AS rows, true AS within_size, 0::BIGINT AS split_topics, 0::BIGINT AS split_subtopics FROM embeddings",
    "award_map_hierarchy_facts": with_base(
        """SELECT count(*) AS rows, true AS within_size, 0::BIGINT AS split_topics, 0::BIGINT AS split_subtopics
FROM (SELECT DISTINCT application_id FROM point)"""
    ),
    "award_map_hierarchy_card_totals": with_base(
        f"""SELECT level, true AS enough, true AS divided, count(*) AS n_awards, {rnd('sum(total_cost)', 0)} AS funding, {rnd('avg(umap_x)', 4)} AS mean_x,
  {rnd('avg(umap_y)', 4)} AS mean_y, true AS parents, true AS labels, true AS apart
FROM (SELECT application_id, {rnd('avg(x)', 6)} AS umap_x, {rnd('avg(y)', 6)} AS umap_y, sum(cost)::DOUBLE AS total_cost FROM point GROUP BY 1),
  (SELECT unnest(['domain', 'topic', 'subtopic']) AS level) GROUP BY 1"""
    ),
    "vector_k_means_facts": FITTED.format("embeddings", 100),
    "vector_bisecting_facts": FITTED.format("embeddings", 50),
    "vector_mini_batch_facts": FITTED.format("embeddings", 20),
    "metadata_cluster_facts": with_base(FITTED.format("award", 75)),
    "sample_assignment_facts": FITTED.format("embeddings", 20),
    "unit_cluster_facts": """SELECT lang, count(*) AS rows, true AS within_size
FROM embeddings JOIN documents ON vec_id = doc_id GROUP BY 1 HAVING count(*) >= 50""",
    "text_projection_facts": with_base("SELECT count(*) AS rows, 0::DOUBLE AS mean_x, 0::DOUBLE AS mean_y FROM award"),
    "scaled_density_facts": with_base('SELECT domain AS "group", count(*) AS rows, 0::BIGINT AS untopical FROM point GROUP BY 1'),
    "region_outline_extents": with_base(
        "SELECT domain, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM point GROUP BY 1"
    ),
}

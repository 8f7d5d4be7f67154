"""Oracles of assignment, samples, texts and cluster reports."""

from oracles import fixed
from oracles.base import in_list, listing, pct, rnd, scaled, with_base
from oracles.institute import top

MPI = pct("count(*) FILTER (WHERE is_mpi)", "count(*)")
FUNDING = scaled("sum(total_lifetime_funding)", "1e9")
ASSIGN = {
    "unit_clusters": f"""SELECT administering_ic, cluster_id, cluster_label, domain_id, domain_name, count(*) AS size,
  {rnd('avg(umap_x)', 4)} AS ax, {rnd('avg(umap_y)', 4)} AS ay
FROM award WHERE cluster_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5
QUALIFY row_number() OVER (PARTITION BY administering_ic ORDER BY count(*) DESC, cluster_id, domain_id) = 1""",
    "assigned": """SELECT core_project_num, coalesce(u.cluster_id, 74) AS cluster_id,
  coalesce(u.cluster_label, 'Unmapped') AS cluster_label, coalesce(u.domain_id, 'D99_UNMAPPED') AS domain_id,
  coalesce(u.domain_name, 'Unmapped') AS domain_name, coalesce(ax, 0.0) AS umap_x, coalesce(ay, 0.0) AS umap_y,
  size AS ic_cluster_size, 'IC-based heuristic' AS assignment_method
FROM award a LEFT JOIN unit_clusters u ON a.administering_ic = u.administering_ic WHERE a.cluster_id IS NULL""",
    "first_wins": """SELECT a.* EXCLUDE (cluster_id, cluster_label, domain_id, domain_name, umap_x, umap_y, is_clustered),
  coalesce(a.cluster_id, p.cluster_id) AS cluster_id, coalesce(a.cluster_label, p.cluster_label) AS cluster_label,
  coalesce(a.domain_id, p.domain_id) AS domain_id, coalesce(a.domain_name, p.domain_name) AS domain_name,
  coalesce(a.umap_x, p.umap_x) AS umap_x, coalesce(a.umap_y, p.umap_y) AS umap_y,
  coalesce(a.cluster_id, p.cluster_id) IS NOT NULL AS is_clustered,
  CASE WHEN a.cluster_id IS NOT NULL THEN 'Phase 1 (ML)' WHEN p.cluster_id IS NOT NULL THEN 'Phase 2 (IC-heuristic)'
    ELSE 'Unclustered' END AS clustering_phase
FROM award a LEFT JOIN assigned p USING (core_project_num)""",
    "second_wins": """SELECT a.* EXCLUDE (cluster_id, cluster_label, domain_id, domain_name, umap_x, umap_y, is_clustered),
  coalesce(p.cluster_id, a.cluster_id) AS cluster_id, coalesce(p.cluster_label, a.cluster_label) AS cluster_label,
  coalesce(p.domain_id, a.domain_id) AS domain_id, coalesce(p.domain_name, a.domain_name) AS domain_name,
  coalesce(p.umap_x, a.umap_x) AS umap_x, coalesce(p.umap_y, a.umap_y) AS umap_y,
  coalesce(p.cluster_id, a.cluster_id) IS NOT NULL AS is_clustered,
  CASE WHEN p.cluster_id IS NOT NULL THEN 'Phase 2' WHEN a.cluster_id IS NOT NULL THEN 'Phase 1'
    ELSE 'Unclustered' END AS clustering_phase
FROM award a LEFT JOIN assigned p USING (core_project_num)""",
    "second_clustered": "SELECT * FROM second_wins WHERE is_clustered",
    "t_ics": top(
        "second_clustered", ["domain_id", "domain_name", "cluster_id", "cluster_label"], "administering_ic", 5, "top_ics"
    ),
}
MERGED = """core_project_num, cluster_id, cluster_label, domain_id, domain_name, umap_x, umap_y, is_clustered,
  clustering_phase"""
NEAR = {
    "known": "SELECT * FROM vec WHERE vec_id IN (SELECT doc_id FROM labels)",
    "fresh": "SELECT * FROM vec WHERE vec_id NOT IN (SELECT doc_id FROM labels)",
    "near": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, reference_id)::INTEGER AS place
FROM (SELECT f.vec_id AS query_id, k.vec_id AS reference_id, k.x, k.y,
  round(list_cosine_similarity(f.embedding, k.embedding), 9) AS similarity FROM fresh f CROSS JOIN known k) QUALIFY place <= 10""",
    "placed": f"""SELECT query_id AS vec_id, {rnd('avg(x)', 6)} AS x, {rnd('avg(y)', 6)} AS y FROM near GROUP BY 1""",
    "centers": f"""SELECT cluster_id, {rnd('avg(x)', 6)} AS cx, {rnd('avg(y)', 6)} AS cy FROM known GROUP BY 1""",
}
NEAR_NAMED = {
    "names": """SELECT cluster_id, cluster_label, domain_id, domain_name FROM award WHERE cluster_id IS NOT NULL
GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY cluster_id
  ORDER BY count(*) DESC, cluster_label, domain_id, domain_name) = 1""",
    "near_assigned": f"""SELECT vec_id, x, y, n.cluster_id, {rnd('d', 6)} AS cluster_distance,
  coalesce(cluster_label, 'Unmapped') AS cluster_label, coalesce(domain_id, 'D99_UNMAPPED') AS domain_id,
  coalesce(domain_name, 'Unmapped') AS domain_name FROM (SELECT * FROM
  (SELECT vec_id, x, y, cluster_id, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS d FROM placed CROSS JOIN centers)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_id) = 1) n LEFT JOIN names s ON n.cluster_id = s.cluster_id""",
}
DIGEST = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
KEY = "concat_ws('-', full_project_num, fy::VARCHAR, total_cost::VARCHAR, project_title)"
ELIGIBLE = "total_cost > 0 AND fy BETWEEN 2000 AND 2024 AND project_title IS NOT NULL"
SAMPLES = {
    "keyed": f"SELECT *, {KEY} AS row_key FROM project",
    "share_ranked": """SELECT *, row_number() OVER (PARTITION BY fy, ic_name ORDER BY md5(row_key), row_key) AS rn,
  count(*) OVER (PARTITION BY fy, ic_name) AS total FROM keyed""",
    "shared_rows": """SELECT * FROM share_ranked WHERE rn <= greatest(1, floor(total * 0.034::DOUBLE + 0.5))
ORDER BY md5('cut:' || row_key), row_key LIMIT 50000""",
    "strata": f"""SELECT *, concat_ws('_', ic_name, fy::INTEGER::VARCHAR,
  CASE WHEN total_cost < 250000 THEN 'LOW' WHEN total_cost < 750000 THEN 'MED' ELSE 'HIGH' END) AS stratum
FROM keyed WHERE {ELIGIBLE}""",
    "quota_rows": "SELECT * FROM keyed WHERE fy BETWEEN 1990 AND 2024 AND project_title IS NOT NULL AND ic_name IS NOT NULL",
    "q1": """SELECT fy, ic_name, n, ceil(n / sum(n) OVER ()::DOUBLE * 100000) AS target
FROM (SELECT fy, ic_name, count(*) AS n FROM quota_rows GROUP BY 1, 2)""",
    "q2": """SELECT fy, ic_name, n, CASE WHEN max(target / n) OVER () > 0.95 AND target / n > 0.9
  THEN floor(n * 0.9::DOUBLE) ELSE target END AS target FROM q1""",
    "q3": "SELECT fy, ic_name, n, round_even(target * (100000::DOUBLE / sum(target) OVER ()), 0) AS target FROM q2",
    "q4": """SELECT fy, ic_name, target + CASE WHEN row_number() OVER (ORDER BY n DESC, fy, ic_name) <=
  abs(100000 - sum(target) OVER ()) THEN sign(100000 - sum(target) OVER ()) ELSE 0 END AS quota FROM q3""",
    "eligible_awards": f"""SELECT *, CASE WHEN first_fiscal_year < 2005 THEN '1990-2004'
  WHEN first_fiscal_year < 2015 THEN '2005-2014' ELSE '2015-2024' END AS era FROM award
WHERE first_fiscal_year >= 2000 AND length(project_title) > 20 AND {in_list(fixed.ELIGIBLE)}""",
    "rule_rows": f"""SELECT *, CASE {' '.join(f"WHEN regexp_matches(spending_cats, '(?i){p}') THEN {n}" for n, p in fixed.DOMAIN_RULES)}
  ELSE 8 END AS domain FROM (SELECT * FROM keyed WHERE {ELIGIBLE} AND {DIGEST.format('row_key')} % 100 < 5
  ORDER BY md5(row_key), row_key LIMIT 50000)""",
    "ruled": f"""SELECT *, {listing(fixed.DOMAIN_NAMES)}[domain] AS domain_label,
  domain * 6 + {DIGEST.format('project_title')} % 6 + 1 AS topic FROM rule_rows""",
    "texts": """SELECT p.application_id::BIGINT::VARCHAR AS "APPLICATION_ID", project_title AS "PROJECT_TITLE",
  fy::INTEGER AS "FISCAL_YEAR", ic_name AS "IC_NAME", total_cost::DOUBLE AS "TOTAL_COST", org_name AS "ORG_NAME",
  org_city AS "ORG_CITY", org_state AS "ORG_STATE", org_country AS "ORG_COUNTRY", pi_names AS "PI_NAMEs",
  abstract_text AS "ABSTRACT_TEXT", project_title || '. ' || abstract_text AS combined_text,
  (length(project_title) + length(abstract_text))::INTEGER AS text_length
FROM project p JOIN abstract a ON p.application_id::BIGINT = a.application_id::BIGINT
WHERE project_title IS NOT NULL AND length(abstract_text) > 100 AND total_cost > 0""",
    "pubs": "SELECT project_number, count(DISTINCT pmid) AS k FROM link GROUP BY 1",
    "trials": """SELECT core, count(DISTINCT trial) AS k, string_agg(DISTINCT status, '; ' ORDER BY status) AS s
FROM study GROUP BY 1""",
}
SAMPLE = """row_key, application_id AS "APPLICATION_ID", project_title AS "PROJECT_TITLE", ic_name AS "IC_NAME", fy AS "FY",
  total_cost::DOUBLE AS "TOTAL_COST" """
IDS = 'application_id::BIGINT AS "APPLICATION_ID", full_project_num AS "FULL_PROJECT_NUM"'
POINT_KEY = "concat_ws('-', application_id::VARCHAR, title, fy::VARCHAR, cost::VARCHAR)"
POINTS = {
    "pairs": "SELECT cluster, ic, count(*) AS n FROM point GROUP BY 1, 2",
    "sizes": "SELECT cluster, sum(n)::BIGINT AS size, count(*) AS ics, arg_max(ic, n) AS unused FROM pairs GROUP BY 1",
    "leads": "SELECT cluster, ic AS lead_ic, n FROM pairs QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, ic) = 1",
    "spans": "SELECT cluster, count(DISTINCT ic) AS units, max(fy) - min(fy) AS span FROM point GROUP BY 1",
    "app_mode": """SELECT application_id, ic FROM (SELECT application_id, ic, count(*) AS n FROM point GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY n DESC, ic) = 1""",
    "first_title": """SELECT application_id, title FROM point
QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY fy, title) = 1""",
    "wide": "SELECT cluster, size, row_number() OVER (ORDER BY size DESC, cluster) AS r FROM sizes",
    "big_units": "SELECT ic, sum(n) AS s FROM pairs GROUP BY 1 ORDER BY s DESC, ic LIMIT 15",
    "reviewed": f"""SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5({POINT_KEY}), {POINT_KEY})::INTEGER AS place
FROM point QUALIFY place <= 10""",
}
SQL = {
    "unclustered_extract": with_base(
        """SELECT core_project_num, administering_ic, organizational_category, project_title, project_terms,
  spending_categories, coalesce(project_title, '') || ' ' || coalesce(project_terms, '') || ' ' ||
  coalesce(spending_categories, '') AS combined_text, total_lifetime_funding::DOUBLE AS total_lifetime_funding,
  publication_count, first_fiscal_year, last_fiscal_year, activity, is_mpi, pi_count
FROM agency_award WHERE cluster_id IS NULL AND project_title IS NOT NULL"""
    ),
    "cluster_centroids": with_base(
        f"""SELECT cluster_id, cluster_label, domain_id, domain_name, {rnd('avg(umap_x)', 6)} AS centroid_x,
  {rnd('avg(umap_y)', 6)} AS centroid_y FROM clustered GROUP BY 1, 2, 3, 4"""
    ),
    "assignments_by_unit_heuristic": with_base("SELECT * FROM assigned", **ASSIGN),
    "nearest_neighbors": with_base(
        f"SELECT query_id, reference_id, {rnd('similarity', 6)} AS similarity, place FROM near", **NEAR
    ),
    "nearest_neighbors_in_cells": with_base(
        f"SELECT query_id, reference_id, {rnd('similarity', 6)} AS similarity, place FROM near", **NEAR
    ),
    "assignments_by_neighbors": with_base(
        f"""SELECT vec_id, x, y, cluster_id, {rnd('d', 6)} AS cluster_distance FROM
  (SELECT vec_id, x, y, cluster_id, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS d FROM placed CROSS JOIN centers)
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_id) = 1""",
        **NEAR,
    ),
    "named_assignments_by_neighbors": with_base("SELECT * FROM near_assigned", **NEAR, **NEAR_NAMED),
    "merged_cards_by_neighbors": with_base(
        """SELECT a.core_project_num, coalesce(a.cluster_id, p.cluster_id) AS cluster_id,
  coalesce(a.cluster_label, p.cluster_label) AS cluster_label, coalesce(a.domain_id, p.domain_id) AS domain_id,
  coalesce(a.domain_name, p.domain_name) AS domain_name, coalesce(a.umap_x, p.x) AS umap_x, coalesce(a.umap_y, p.y) AS umap_y,
  coalesce(a.cluster_id, p.cluster_id) IS NOT NULL AS is_clustered,
  CASE WHEN a.cluster_id IS NOT NULL THEN 'Phase 1 (ML)' WHEN p.cluster_id IS NOT NULL THEN 'Phase 2 (ML)'
    ELSE 'Unclustered' END AS clustering_phase
FROM award a LEFT JOIN near_assigned p ON a.core_project_num = 'P' || p.vec_id""",
        **NEAR, **NEAR_NAMED,
    ),
    "merged_cards_existing_first": with_base(f"SELECT {MERGED} FROM first_wins", **ASSIGN),
    "merged_cards_assigned_first": with_base(f"SELECT {MERGED} FROM second_wins", **ASSIGN),
    "phase_coverage": with_base(
        f"""SELECT clustering_phase, count(*) AS num_awards, {FUNDING} AS funding_billions,
  {pct('count(*)', 'sum(count(*)) OVER ()')} AS pct_total, count(DISTINCT administering_ic) AS num_ics,
  count(DISTINCT domain_id) AS num_domains, count(DISTINCT cluster_id) AS num_clusters FROM first_wins GROUP BY 1""",
        **ASSIGN,
    ),
    "portfolio_domain_summary": with_base(
        f"""SELECT domain_id, domain_name, is_research_topic, count(*) AS num_awards, {FUNDING} AS funding_billions,
  {rnd('avg(publication_count)', 1)} AS avg_pubs, {rnd('avg(pi_count)', 2)} AS avg_pi_count,
  count(*) FILTER (WHERE is_mpi) AS mpi_awards, {MPI} AS pct_mpi,
  count(*) FILTER (WHERE clustering_phase = 'Phase 1') AS phase1_awards,
  count(*) FILTER (WHERE clustering_phase = 'Phase 2') AS phase2_awards,
  min(first_fiscal_year) AS earliest_year, max(last_fiscal_year) AS latest_year
FROM second_wins WHERE is_clustered GROUP BY 1, 2, 3""",
        **ASSIGN,
    ),
    "portfolio_cluster_summary": with_base(
        f"""SELECT s.*, top_ics FROM (SELECT domain_id, domain_name, cluster_id, cluster_label, count(*) AS num_awards,
  {FUNDING} AS funding_billions, {rnd('avg(publication_count)', 1)} AS avg_pubs,
  count(*) FILTER (WHERE clustering_phase = 'Phase 1') AS phase1_awards,
  count(*) FILTER (WHERE clustering_phase = 'Phase 2') AS phase2_awards,
  {rnd('avg(umap_x)', 4)} AS centroid_x, {rnd('avg(umap_y)', 4)} AS centroid_y
 FROM second_clustered GROUP BY 1, 2, 3, 4) s
LEFT JOIN t_ics USING (domain_id, domain_name, cluster_id, cluster_label)""",
        **ASSIGN,
    ),
    "sample_year_unit_share": with_base(f"SELECT {SAMPLE} FROM shared_rows", **SAMPLES),
    "sample_proportional_strata": with_base(
        f"""SELECT {SAMPLE}, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(row_key), row_key) AS rn,
  ceil(count(*) OVER (PARTITION BY stratum) * 50000::DOUBLE / count(*) OVER ()) AS target FROM strata)
WHERE rn <= target ORDER BY md5('cut:' || row_key), row_key LIMIT 50000""",
        **SAMPLES,
    ),
    "sample_year_unit_quota": with_base(
        f"""SELECT {SAMPLE} FROM (SELECT *, row_number() OVER (PARTITION BY fy, ic_name ORDER BY md5(row_key), row_key) AS rn
  FROM quota_rows) JOIN q4 USING (fy, ic_name) WHERE rn <= quota""",
        **SAMPLES,
    ),
    "sample_equal_eras": with_base(
        """SELECT core_project_num, administering_ic, activity, project_title, first_fiscal_year, last_fiscal_year,
  total_lifetime_funding::DOUBLE AS total_lifetime_funding, era FROM (SELECT *, row_number() OVER (
    PARTITION BY administering_ic, era ORDER BY md5(core_project_num), core_project_num) AS rn FROM eligible_awards)
WHERE rn <= floor(250000::DOUBLE / (SELECT count(*) FROM (SELECT DISTINCT administering_ic, era FROM eligible_awards)) + 0.5)
ORDER BY md5('cut:' || core_project_num), core_project_num LIMIT 250000""",
        **SAMPLES,
    ),
    "sample_rule_domains": with_base(f"SELECT {SAMPLE}, domain, domain_label, topic FROM ruled", **SAMPLES),
    "rule_domain_totals": with_base(
        f"""SELECT domain, domain_label, count(*) AS grants, {rnd('sum(total_cost)::DOUBLE / 1e9::DOUBLE', 4)} AS funding_billions
FROM ruled GROUP BY 1, 2""",
        **SAMPLES,
    ),
    "sample_label_coverage": with_base(
        f"""SELECT count(*) AS rows, {rnd('avg((spending_cats IS NOT NULL)::INTEGER)', 4)} AS category_coverage,
  {rnd('avg((abstract_text IS NOT NULL)::INTEGER)', 4)} AS abstract_coverage,
  {rnd('avg((project_title IS NOT NULL)::INTEGER)', 4)} AS title_coverage
FROM shared_rows s LEFT JOIN abstract a ON s.application_id::BIGINT = a.application_id::BIGINT""",
        **SAMPLES,
    ),
    "grant_text": with_base("SELECT * FROM texts", **SAMPLES),
    "unified_table_statistics": with_base(
        """SELECT 'projects_all' AS table_name, count(*) AS row_count, min(fy)::INTEGER AS min_year,
  max(fy)::INTEGER AS max_year, count(DISTINCT administering_ic) AS unique_ics FROM project
UNION ALL SELECT 'abstracts_all', count(*), min(year), max(year), NULL::BIGINT FROM abstract
UNION ALL SELECT 'grant_text', count(*), min("FISCAL_YEAR"), max("FISCAL_YEAR"), count(DISTINCT "IC_NAME") FROM texts""",
        **SAMPLES,
    ),
    "grant_text_by_year": with_base(
        f"""SELECT "FISCAL_YEAR", count(*) AS grant_count,
  {rnd('sum("TOTAL_COST"::DECIMAL(18,2))::DOUBLE / 1e9::DOUBLE', 4)} AS total_funding_billions,
  {rnd('avg(text_length)', 0)} AS avg_text_length FROM texts GROUP BY 1""",
        **SAMPLES,
    ),
    "grant_text_by_unit": with_base(
        f"""SELECT "IC_NAME", count(*) AS grant_count,
  {rnd('sum("TOTAL_COST"::DECIMAL(18,2))::DOUBLE / 1e9::DOUBLE', 4)} AS total_funding_billions
FROM texts GROUP BY 1 ORDER BY grant_count DESC, 1 LIMIT 15""",
        **SAMPLES,
    ),
    "grants_with_abstracts": with_base(
        """SELECT p.application_id::BIGINT AS "APPLICATION_ID", full_project_num AS "FULL_PROJECT_NUM", fy AS "FY",
  md5(abstract_text) AS abstract_md5
FROM project p LEFT JOIN abstract a ON p.application_id::BIGINT = a.application_id::BIGINT"""
    ),
    "grants_with_publications": with_base(
        """SELECT application_id AS "APPLICATION_ID", full_project_num AS "FULL_PROJECT_NUM",
  core_project_num AS "CORE_PROJECT_NUM", fy AS "FY", coalesce(k, 0) AS publication_count
FROM project LEFT JOIN pubs ON core_project_num = project_number""",
        **SAMPLES,
    ),
    "grants_with_clinical_trials": with_base(
        """SELECT application_id AS "APPLICATION_ID", full_project_num AS "FULL_PROJECT_NUM",
  core_project_num AS "CORE_PROJECT_NUM", fy AS "FY", coalesce(k, 0) AS trial_count, coalesce(s, '') AS trial_statuses
FROM project LEFT JOIN trials ON core_project_num = core""",
        **SAMPLES,
    ),
    "award_map": with_base(
        f"""SELECT application_id, {rnd('avg(x)', 6)} AS umap_x, {rnd('avg(y)', 6)} AS umap_y, sum(cost)::DOUBLE AS total_cost,
  any_value(m.ic) AS ic_name, any_value(t.title) AS project_title, max(fy) AS fy
FROM point JOIN app_mode m USING (application_id) JOIN first_title t USING (application_id) GROUP BY 1""",
        **POINTS,
    ),
    "cluster_summary": with_base(
        f"""SELECT cluster, count(*) AS n_grants, {rnd('sum(cost)', 0)} AS total_funding,
  {rnd('sum(cost)::DOUBLE / count(cost)', 0)} AS avg_funding, min(fy) AS fy_min, max(fy) AS fy_max,
  any_value(lead_ic) AS lead_ic FROM point LEFT JOIN leads USING (cluster) GROUP BY 1""",
        **POINTS,
    ),
    "largest_clusters": with_base(
        """SELECT cluster, count(*) AS grants, count(DISTINCT ic) AS unique_ics, min(fy) AS earliest_fy, max(fy) AS latest_fy
FROM point GROUP BY 1 ORDER BY grants DESC, cluster LIMIT 10"""
    ),
    "titles_of_largest_clusters": with_base(
        f"""SELECT cluster, title AS project_title, ic AS ic_name, fy FROM point
WHERE cluster IN (SELECT cluster FROM sizes ORDER BY size DESC, cluster LIMIT 3)
ORDER BY cluster, md5({POINT_KEY}), {POINT_KEY} LIMIT 30""",
        **POINTS,
    ),
    "cluster_unit_purity": with_base(
        f"""SELECT cluster, size AS total_grants, lead_ic AS dominant_ic, n AS dominant_ic_count,
  {rnd('n::DOUBLE / size', 3)} AS ic_purity FROM leads JOIN sizes USING (cluster)
ORDER BY size DESC, cluster LIMIT 20""",
        **POINTS,
    ),
    "cluster_temporal_mix": with_base(
        f"""SELECT cluster, count(*) AS total, count(*) FILTER (WHERE fy >= 2020) AS recent_2020plus,
  {rnd('count(*) FILTER (WHERE fy >= 2020)::DOUBLE / count(*)', 3)} AS pct_recent,
  count(*) FILTER (WHERE fy >= 2015 AND fy < 2020) AS mid_2015_2019,
  count(*) FILTER (WHERE fy < 2015) AS older_pre2015 FROM point GROUP BY 1 ORDER BY total DESC, cluster LIMIT 10"""
    ),
    "cluster_size_bands": with_base(
        """SELECT CASE WHEN size < 500 THEN 'tiny (<500)' WHEN size < 2000 THEN 'small (500-2k)'
  WHEN size < 4000 THEN 'medium (2k-4k)' ELSE 'large (4k+)' END AS band, count(*) AS clusters FROM sizes GROUP BY 1""",
        **POINTS,
    ),
    "cluster_size_statistics": with_base(
        f"""SELECT min(size) AS min_size, max(size) AS max_size, {rnd('avg(size)', 1)} AS mean_size,
  quantile_cont(size, 0.5)::DOUBLE AS median_size, {rnd('avg(ics)', 1)} AS mean_ics, max(ics) AS max_ics,
  count(*) FILTER (WHERE ics > 25) AS generic_clusters, count(*) FILTER (WHERE size < 100) AS small_clusters
FROM sizes""",
        **POINTS,
    ),
    "cluster_coverage_bands": with_base(
        """SELECT count(*) FILTER (WHERE units = 1) AS ics_1, count(*) FILTER (WHERE units BETWEEN 2 AND 5) AS ics_2_5,
  count(*) FILTER (WHERE units BETWEEN 6 AND 10) AS ics_6_10, count(*) FILTER (WHERE units > 10) AS ics_over_10,
  count(*) FILTER (WHERE span < 10) AS span_under_10, count(*) FILTER (WHERE span >= 10 AND span < 20) AS span_10_20,
  count(*) FILTER (WHERE span >= 20) AS span_20_up FROM spans""",
        **POINTS,
    ),
    "unit_cluster_crosstab": with_base(
        "SELECT ic, "
        + ", ".join(f"coalesce(sum(n) FILTER (WHERE r = {r}), 0)::BIGINT AS c{r:02d}" for r in range(1, 21))
        + " FROM pairs JOIN wide USING (cluster) WHERE r <= 20 AND ic IN (SELECT ic FROM big_units) GROUP BY 1",
        **POINTS,
    ),
    "cluster_review_titles": with_base(
        """SELECT cluster, size, ics, lead_ic AS top_ic, place, substr(title, 1, 100) AS title FROM reviewed
JOIN (SELECT cluster, size, ics FROM sizes ORDER BY size DESC, cluster LIMIT 10) USING (cluster)
LEFT JOIN leads USING (cluster)""",
        **POINTS,
    ),
}

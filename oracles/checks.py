"""Oracles of validation, profiling and slices."""

from oracles.base import pct, rnd, with_base
from oracles.institute import FULL, LEAN
from oracles.people import SQL as CARDS
from oracles.portfolio import ASSIGN

FUND = rnd("sum(total_cost)::DOUBLE / 1e9::DOUBLE", 4)


MORE = ("cooperative", "ctsa", "t32", "rcmi")


def total(name, sql, awards, funding, rpg, centers, training, years=False, **more):
    extra = ", ".join(f"{f'sum({more[n]})' if n in more else 'NULL'}::BIGINT AS {n}" for n in MORE)
    extra += ", min(fiscal_year)::INTEGER AS first_year, max(fiscal_year)::INTEGER AS last_year" if years else (
        ", NULL::INTEGER AS first_year, NULL::INTEGER AS last_year"
    )
    return f"""SELECT '{name}' AS card_type, count(*) AS entities, sum({awards})::BIGINT AS awards,
  {rnd(f'sum({funding})')} AS funding_billions, sum({rpg})::BIGINT AS rpg, sum({centers})::BIGINT AS centers,
  sum({training})::BIGINT AS training, {extra} FROM ({sql})"""


def internal(name, sql, contracts, intramural):
    return f"""SELECT '{name}' AS card_type, count(*) AS num_entities, sum({contracts})::BIGINT AS total_contracts,
  sum({intramural})::BIGINT AS total_intramural FROM ({sql})"""


NULLS = {
    "null_core_project": "core_project_num", "null_fy": "fy", "null_ic": "administering_ic",
    "null_title": "project_title", "null_cost": "total_cost", "null_pi": "pi_names",
}
PROFILED = {
    "APPLICATION_ID": ("application_id", "double"), "FY": ("fy", "double"),
    "CORE_PROJECT_NUM": ("core_project_num", "string"), "FULL_PROJECT_NUM": ("full_project_num", "string"),
    "TOTAL_COST": ("total_cost", "decimal(18,2)"), "ACTIVITY": ("activity", "string"),
    "ADMINISTERING_IC": ("administering_ic", "string"), "IC_NAME": ("ic_name", "string"),
    "PI_NAMEs": ("pi_names", "string"), "ORG_NAME": ("org_name", "string"), "ORG_CITY": ("org_city", "string"),
    "ORG_STATE": ("org_state", "string"), "ORG_COUNTRY": ("org_country", "string"),
    "PROJECT_TITLE": ("project_title", "string"), "PROJECT_TERMS": ("project_terms", "string"),
    "SPENDING_CATS": ("spending_cats", "string"),
}


def profiled(shown, column, dtype):
    length = rnd(f"avg(length({column}))", 1) if dtype == "string" else "NULL::DOUBLE"
    return f"""SELECT '{shown}' AS column_name, '{dtype}' AS dtype, count({column}) AS non_null,
  {pct(f'count(*) - count({column})', 'count(*)')} AS null_pct, {length} AS avg_length FROM project"""


def cataloged(name, columns, year="NULL"):
    return f"""SELECT '{name}' AS table_name, '{name}.parquet' AS file, count(*) AS rows, {columns}::INTEGER AS column_count,
  'other' AS kind, min({year})::INTEGER AS min_year, max({year})::INTEGER AS max_year FROM {name}"""


def grouped(level):
    return f"""SELECT '{level}' AS level, {level} AS id, count(*) AS grants,
  {rnd('sum(cost)::DOUBLE / 1e6::DOUBLE')} AS funding_millions, min(fy) AS first_year, max(fy) AS last_year
FROM point WHERE fy >= 2005 AND contains(lower(title), 'systems') GROUP BY 2"""


TOTALS = f"count(*) AS grants, {rnd('sum(cost)::DOUBLE / 1e9::DOUBLE', 4)} AS funding_billions"
SQL = {
    "validate_table_counts": with_base(
        f"""SELECT 'projects' AS table_name, count(*) AS total_rows, min(fy)::INTEGER AS min_year, max(fy)::INTEGER AS max_year,
  count(DISTINCT fy) AS year_count, {rnd('sum(total_cost)::DOUBLE / 1e9::DOUBLE')} AS total_funding_billions FROM project
UNION ALL SELECT 'abstracts', count(*), min(year), max(year), count(DISTINCT year), NULL FROM abstract
UNION ALL SELECT 'linktables', count(*), NULL, NULL, NULL, NULL FROM link
UNION ALL SELECT 'patents', count(*), NULL, NULL, NULL, NULL FROM pages
UNION ALL SELECT 'clinicalstudies', count(*), NULL, NULL, NULL, NULL FROM study"""
    ),
    "validate_projects_by_year": with_base(
        f"""SELECT fy::INTEGER AS fiscal_year, count(*) AS project_count, count(DISTINCT core_project_num) AS unique_cores,
  count(DISTINCT administering_ic) AS ic_count, {FUND} AS funding_billions FROM project GROUP BY 1"""
    ),
    "validate_abstracts_by_year": with_base(
        """SELECT year AS fiscal_year, count(*) AS abstract_count, count(DISTINCT application_id) AS unique_applications
FROM abstract GROUP BY 1"""
    ),
    "validate_missing_years": with_base(
        """SELECT y::INTEGER AS missing_year FROM range(1990, 2025) r(y)
WHERE y NOT IN (SELECT fy::INTEGER FROM project)"""
    ),
    "validate_projects_by_unit": with_base(
        f"""SELECT administering_ic AS ic_code, count(*) AS project_count, {FUND} AS funding_billions,
  min(fy)::INTEGER AS first_year, max(fy)::INTEGER AS last_year FROM project WHERE administering_ic IS NOT NULL
GROUP BY 1 ORDER BY project_count DESC, ic_code LIMIT 30"""
    ),
    "validate_null_counts": with_base(
        "SELECT "
        + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {n}" for n, c in NULLS.items())
        + f", count(*) AS total_rows, {pct('count(*) FILTER (WHERE core_project_num IS NULL)', 'count(*)', 2)} AS pct_null_core FROM project"
    ),
    "validate_duplicates": with_base(
        """SELECT count(*) AS total_records, count(DISTINCT full_project_num) AS unique_full_project_nums,
  count(*) - count(DISTINCT full_project_num) AS duplicate_count FROM project"""
    ),
    "validate_cost_by_year": with_base(
        f"""SELECT fy::INTEGER AS fiscal_year, count(*) AS projects_with_cost, min(total_cost)::DOUBLE AS min_cost,
  quantile_disc(total_cost, 0.5)::DOUBLE AS median_cost, max(total_cost)::DOUBLE AS max_cost,
  {rnd('sum(total_cost)::DOUBLE / count(total_cost)')} AS avg_cost
FROM project WHERE total_cost > 0 GROUP BY 1 ORDER BY 1 DESC LIMIT 10"""
    ),
    "validate_abstract_coverage": with_base(
        f"""SELECT *, {pct('matched_apps', 'total_project_apps', 2)} AS match_percentage FROM (SELECT
  (SELECT count(DISTINCT application_id) FROM project) AS total_project_apps,
  (SELECT count(DISTINCT application_id) FROM abstract) AS total_abstract_apps,
  (SELECT count(DISTINCT application_id) FROM project JOIN abstract USING (application_id)) AS matched_apps)"""
    ),
    "validate_trial_links": with_base(
        """SELECT count(*) AS total_clinical_studies, count(DISTINCT core) AS unique_projects_linked,
  count(DISTINCT trial) AS unique_trial_ids FROM study"""
    ),
    "validate_card_totals": " UNION ALL ".join(
        [
            total("units", FULL, "total_projects", "total_funding_billions", "rpg_standard_count", "centers_p_count", "training_t_count",
                  cooperative="coop_agreements_u_count"),
            total("people", CARDS["pi_cards_comprehensive"], "total_awards", "total_funding_millions / 1e3::DOUBLE",
                  "rpg_awards", "center_awards", "training_awards"),
            total("institutions", CARDS["institution_cards_comprehensive"], "total_awards", "total_funding_billions",
                  "rpg_total", "center_total", "training_total",
                  ctsa="ul1_ctsa_awards", t32="t32_awards", rcmi="g12_rcmi_awards"),
            total("years", CARDS["temporal_trends_comprehensive"], "total_awards", "total_funding_billions",
                  "rpg_awards", "center_awards", "training_awards", years=True),
        ]
    ),
    "validate_internal_mechanisms": " UNION ALL ".join(
        [
            internal("IC Cards", LEAN, "contract_count", "intramural_count"),
            internal("PI Cards", CARDS["pi_cards_cleaned_names"], "contract_awards", "intramural_awards"),
            internal("Institution Cards", CARDS["institution_cards_external"], "contract_total", "intramural_total"),
        ]
    ),
    "validate_assignment_metrics": with_base(
        """SELECT 'Total Records' AS metric, count(*)::VARCHAR AS value FROM assigned
UNION ALL SELECT 'Unique Projects', count(DISTINCT core_project_num)::VARCHAR FROM assigned
UNION ALL SELECT 'Unique Clusters', count(DISTINCT cluster_id)::VARCHAR FROM assigned
UNION ALL SELECT 'Unique Domains', count(DISTINCT domain_id)::VARCHAR FROM assigned
UNION ALL SELECT 'Null Clusters', count(*) FILTER (WHERE cluster_id IS NULL)::VARCHAR FROM assigned""",
        **ASSIGN,
    ),
    "validate_assignment_shares": with_base(
        f"""SELECT cluster_id, min(cluster_label) AS cluster_label, min(domain_name) AS domain_name, count(*) AS num_awards,
  {pct('count(*)', '(SELECT count(*) FROM assigned)')} AS pct
FROM assigned GROUP BY 1 ORDER BY num_awards DESC, cluster_id LIMIT 15""",
        **ASSIGN,
    ),
    "validate_phase_overlap": with_base(
        """SELECT 'Phase 2 Awards' AS metric, count(DISTINCT core_project_num) AS count FROM assigned
UNION ALL SELECT 'Already Clustered (Phase 1)', count(DISTINCT core_project_num) FROM clustered
UNION ALL SELECT 'Overlap (Should be 0)', count(*) FROM assigned JOIN clustered USING (core_project_num)""",
        **ASSIGN,
    ),
    "validate_clustering_status": with_base(
        f"""SELECT 'Current Status' AS status, count(*) FILTER (WHERE cluster_id IS NOT NULL) AS clustered,
  count(*) FILTER (WHERE cluster_id IS NULL) AS unclustered, count(*) AS total,
  {pct('count(*) FILTER (WHERE cluster_id IS NOT NULL)', 'count(*)')} AS pct_clustered FROM award"""
    ),
    "file_catalog": " UNION ALL ".join(
        [
            cataloged("region", 2), cataloged("nation", 3), cataloged("customer", 5), cataloged("supplier", 4),
            cataloged("part", 6), cataloged("orders", 6, "year(o_orderdate)"), cataloged("lineitem", 11, "year(l_shipdate)"),
            cataloged("events", 6, "year(ts)"), cataloged("documents", 5), cataloged("embeddings", 3), cataloged("pages", 3),
            cataloged("benchmark", 2), cataloged("labels", 3), cataloged("conversations", 4),
        ]
    ),
    "column_profile": with_base(" UNION ALL ".join(profiled(n, c, d) for n, (c, d) in PROFILED.items())),
    "unique_key_check": with_base(
        """SELECT 'APPLICATION_ID' AS key, count(*) AS total_rows, count(DISTINCT application_id) AS unique_ids,
  count(*) - count(DISTINCT application_id) AS duplicates FROM project"""
    ),
    "year_distribution": with_base("SELECT fy::INTEGER AS year, count(*) AS records FROM project GROUP BY 1"),
    "payload_records": """SELECT event_id, user_id, event_type, value, k FROM (SELECT *,
  CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) = 1""",
    "point_records": with_base(
        """SELECT x, y, cluster, application_id::VARCHAR AS application_id, coalesce(substr(title, 1, 200), '') AS title, ic,
  fy AS year, coalesce(cost::DOUBLE, 0) AS cost FROM point"""
    ),
    "slice_totals": with_base(
        f"""SELECT {TOTALS} FROM point WHERE ic IN ('CA', 'HL', 'AI') AND fy BETWEEN 2000 AND 2015
  AND contains(lower(title), 'ring') AND domain IN (0, 2, 4)"""
    ),
    "slice_search": with_base(
        """SELECT application_id, title, ic, fy, cost::DOUBLE AS cost, domain, topic FROM point WHERE fy >= 1995
  AND topic IN (1, 11, 21, 31) AND (contains(lower(title), '77') OR contains(application_id::VARCHAR, '77'))"""
    ),
    "slice_group_counts": with_base(" UNION ALL ".join(grouped(level) for level in ("domain", "topic", "subtopic"))),
    "slice_topic_legend": with_base(
        f"""SELECT topic, count(*) AS count, {rnd('avg(x)', 4)} AS x, {rnd('avg(y)', 4)} AS y FROM point
GROUP BY 1 ORDER BY count DESC, topic LIMIT 25"""
    ),
    "slice_topic_totals": with_base(f"SELECT {TOTALS} FROM point WHERE topic IN (0, 12, 23)"),
    "slice_facets": with_base(
        """SELECT DISTINCT 'ic' AS facet, ic AS value FROM point
UNION ALL SELECT 'years', min(fy) || '-' || max(fy) FROM point"""
    ),
}

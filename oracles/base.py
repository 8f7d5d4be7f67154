"""Shared CTEs: the portfolio model in DuckDB SQL over the registered views."""

from __future__ import annotations

import re

from oracles.fixed import ACTIVITY_CODES, CATEGORIES, DOMAINS, UNIT_CODES, UNITS


def listing(values) -> str:
    return "[" + ", ".join(f"'{value}'" for value in values) + "]"


def in_list(family) -> str:
    tests = [f"starts_with(activity, '{p}')" for p in family.prefixes]
    if family.codes:
        tests.append("activity IN (" + ", ".join(f"'{c}'" for c in family.codes) + ")")
    return "(" + " OR ".join(tests) + ")"


def rnd(value: str, digits: int = 2) -> str:
    """Half away from zero."""
    scale = f"1e{digits}::DOUBLE"
    size = f"floor(abs(({value})::DOUBLE) * {scale} + 0.5::DOUBLE) / {scale}"
    return f"(CASE WHEN ({value})::DOUBLE < 0 THEN 0::DOUBLE - {size} ELSE {size} END)"


def scaled(value: str, unit: str, digits: int = 2) -> str:
    return rnd(f"({value})::DOUBLE / {unit}::DOUBLE", digits)


def pct(part: str, whole: str, digits: int = 1) -> str:
    return rnd(f"({part})::DOUBLE * 100.0::DOUBLE / nullif(({whole})::DOUBLE, 0)", digits)


def fy(day: str) -> str:
    return f"(1990 + ((year({day}) - 1995) * 12 + month({day}) - 1) * 5 // 12)::INTEGER"


SHIFT = 1 << 56
N_CAT = len(CATEGORIES)
PERSON = "(CASE WHEN c_acctbal < -500 THEN 'TBD, TBD' ELSE replace(c_name, 'Customer#', 'CUSTOMER, ') END)"
ORG = """(CASE s_nationkey WHEN 0 THEN 'NATIONAL INSTITUTE LABORATORY ' || s_name
  WHEN 1 THEN 'NATIONAL CENTER FOR ' || s_name WHEN 2 THEN 'DIVISION OF BASIC SCIENCES NCI ' || s_name
  ELSE s_name || ' UNIVERSITY' END)"""
BRAND = "substr(p_brand, 7)::INTEGER"
TITLE = "(p_name || ' in ' || lower(p_type) || ' systems ' || lower(p_brand))"
TERMS = """(split_part(p_name, ' ', 1) || '; ' || split_part(p_name, ' ', 2) || '; ' || split_part(p_name, ' ', 2)
  || 's; ' || split_part(p_name, ' ', 2) || ' systems; ' || lower(p_type))"""
CATS = f"""(CASE WHEN p_size <= 45 THEN {listing(CATEGORIES)}[(p_partkey % {N_CAT} + 1)::INTEGER] || '; ' ||
  {listing(CATEGORIES)}[p_size % {N_CAT} + 1] END)"""
X = f"(({BRAND} % 5) * 10 + p_size / 8.0::DOUBLE)"
Y = f"(({BRAND} // 5) * 10 + (p_partkey % 80) / 8.0::DOUBLE)"
UNIT = f"{listing(UNIT_CODES)}[c_nationkey + 1]"
ACTIVITY = f"{listing(ACTIVITY_CODES)}[((o_orderkey * 31 + o_custkey) % {len(ACTIVITY_CODES)} + 1)::INTEGER]"

CTES: dict[str, str] = {
    "line_facts": f"""SELECT l_orderkey, min({fy('l_shipdate')}) AS lf, max({fy('l_shipdate')}) AS ll,
  list_sort(list(DISTINCT {fy('l_shipdate')})) AS ly,
  (min(l_linenumber::BIGINT * {SHIFT} + l_partkey) & {SHIFT - 1}) AS lead_part,
  (min(l_linenumber::BIGINT * {SHIFT} + l_suppkey) & {SHIFT - 1}) AS lead_supp,
  count(*) FILTER (WHERE l_linestatus = 'F') AS pubs, sum(l_quantity)::BIGINT AS cites, count(*) AS subs,
  min(l_suppkey) AS ls, max(l_suppkey) AS hs, sum(l_extendedprice::DECIMAL(18,2)) AS direct,
  coalesce(list_sort(list(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'R')), []) AS partners
FROM lineitem GROUP BY l_orderkey""",
    "award": f"""SELECT 'P' || o_orderkey AS core_project_num, {ACTIVITY} AS activity,
  coalesce(lf, {fy('o_orderdate')}) AS first_fiscal_year, coalesce(ll, {fy('o_orderdate')}) AS last_fiscal_year,
  coalesce(ly, [{fy('o_orderdate')}]) AS years, len(coalesce(ly, [1]))::INTEGER AS distinct_fiscal_years,
  o_totalprice::DECIMAL(18,2) AS total_lifetime_funding, coalesce(direct, 0)::DECIMAL(28,2) AS total_direct_costs,
  o_totalprice::DECIMAL(18,2)::DOUBLE / len(coalesce(ly, [1])) AS avg_annual_funding,
  coalesce(pubs, 0) AS publication_count, coalesce(cites, 0) AS citation_count, coalesce(subs, 0) AS subproject_count,
  coalesce(ls < hs, false) AS is_multisite, o_orderstatus AS award_type, {UNIT} AS administering_ic,
  n_name AS ic_name, r_name AS agency, c_mktsegment AS org_dept, {PERSON} AS contact_pi_name,
  array_to_string(list_concat([replace({PERSON}, ', ', ',  ') || ' (contact)'],
    list_transform(coalesce(partners, []), lambda k: 'Investigator, ' || k)), ' | ') AS all_pis,
  array_to_string(list_transform(coalesce(partners, []), lambda k: 'Investigator, ' || k), '; ') AS all_pi_names,
  len(coalesce(partners, [])) + 1 AS pi_count, len(coalesce(partners, [])) > 0 AS is_mpi,
  {ORG} AS primary_org, 'S' || s_nationkey AS primary_state, 'CITY ' || (s_nationkey * 2) AS org_city,
  CASE WHEN s_suppkey IS NULL THEN 'OTHER' WHEN s_nationkey < 20 THEN 'UNITED STATES' ELSE 'OTHER' END AS org_country,
  s_suppkey::VARCHAR AS org_zipcode, {TITLE} AS project_title, {TERMS} AS project_terms,
  {CATS} AS spending_categories, (o_orderstatus <> 'P' AND p_partkey IS NOT NULL) AS is_clustered,
  CASE WHEN o_orderstatus <> 'P' THEN {BRAND} END AS cluster_id,
  CASE WHEN o_orderstatus <> 'P' THEN p_brand || ' Research' END AS cluster_label,
  CASE WHEN o_orderstatus <> 'P' THEN 'D_' || p_type END AS domain_id,
  CASE WHEN o_orderstatus <> 'P' THEN p_type END AS domain_name,
  CASE WHEN o_orderstatus <> 'P' THEN p_type <> 'PROMO' END AS is_research_topic,
  CASE WHEN o_orderstatus <> 'P' THEN {X} END AS umap_x, CASE WHEN o_orderstatus <> 'P' THEN {Y} END AS umap_y
FROM orders LEFT JOIN line_facts ON o_orderkey = l_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON lead_supp = s_suppkey
  LEFT JOIN part ON lead_part = p_partkey""",
    "clustered": "SELECT * FROM award WHERE cluster_id IS NOT NULL",
    "units": "SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in UNITS)
    + ") AS t(ic_code, unit_name, unit_agency, unit_type, unit_department, sort_order)",
    "agency_award": """SELECT award.*, coalesce(unit_name, 'Unknown IC') AS ic_full_name,
  coalesce(unit_agency, 'Unknown') AS funding_agency, coalesce(unit_type, 'Unknown') AS ic_type,
  coalesce(unit_department, 'Unknown') AS department,
  CASE WHEN unit_agency = 'NIH' AND unit_type IN ('Research IC', 'Support IC', 'Common Fund')
         THEN 'NIH ' || replace(unit_type, ' IC', '')
       WHEN unit_agency = 'NIH' AND unit_type = 'Trans-NIH' THEN 'NIH Trans-IC'
       WHEN unit_agency IN ('FDA', 'CDC') THEN unit_agency
       WHEN unit_department = 'HHS' THEN 'Other HHS'
       WHEN unit_department IN ('VA', 'DOD', 'NASA', 'DOE') THEN unit_department
       ELSE 'Other Federal' END AS organizational_category
FROM award LEFT JOIN units ON administering_ic = ic_code""",
    "project": f"""SELECT (l_orderkey * 8 + l_linenumber)::DOUBLE AS application_id, {fy('l_shipdate')}::DOUBLE AS fy,
  CASE WHEN NOT (l_quantity = 1 AND l_returnflag = 'R') THEN 'P' || l_orderkey END AS core_project_num,
  l_orderkey || '-' || l_linenumber AS full_project_num,
  CASE WHEN l_tax > 0 THEN (l_extendedprice::DECIMAL(18,2) * 10)::DECIMAL(18,2) END AS total_cost,
  {ACTIVITY} AS activity, CASE WHEN l_discount > 0 THEN {UNIT} END AS administering_ic, {UNIT} AS ic_name,
  CASE WHEN l_quantity > 2 THEN {PERSON} END AS pi_names, {ORG} AS org_name, 'CITY ' || (s_nationkey * 2) AS org_city,
  'S' || s_nationkey AS org_state, CASE WHEN s_nationkey < 20 THEN 'UNITED STATES' ELSE 'OTHER' END AS org_country,
  CASE WHEN l_quantity < 50 THEN {TITLE} END AS project_title, {TERMS} AS project_terms, {CATS} AS spending_cats
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey""",
    "point": f"""SELECT l_orderkey * 8 + l_linenumber AS application_id, {listing(UNIT_CODES)}[s_nationkey + 1] AS ic,
  {fy('l_shipdate')} AS fy, (l_extendedprice::DECIMAL(18,2) * 10)::DECIMAL(18,2) AS cost, {TITLE} AS title,
  {TERMS} AS terms, {CATS} AS categories, {X} AS x, {Y} AS y, ({BRAND} * 3 - 3 + p_size % 3)::INTEGER AS cluster,
  (list_position({listing(DOMAINS)}, p_type) - 1)::INTEGER AS domain, p_type AS domain_label,
  ((list_position({listing(DOMAINS)}, p_type) - 1) * 10 + {BRAND} % 4)::INTEGER AS topic,
  (((list_position({listing(DOMAINS)}, p_type) - 1) * 10 + {BRAND} % 4) * 10 + p_size % 3)::INTEGER AS subtopic
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "abstract": """SELECT doc_id::DOUBLE AS application_id, text AS abstract_text,
  (1990 + n_chars % 35)::INTEGER AS year FROM documents""",
    "link": """SELECT event_id::DOUBLE AS pmid, 'P' || user_id AS project_number, year(ts)::INTEGER AS year
FROM events WHERE event_type <> 'signup'""",
    "study": """SELECT 'P' || user_id AS core, 'NCT' || event_id AS trial,
  CASE WHEN value < 5 THEN 'Completed' WHEN value < 20 THEN 'Recruiting' ELSE 'Terminated' END AS status
FROM events WHERE event_type = 'signup'""",
    "vec": """SELECT vec_id, embedding::DOUBLE[] AS embedding, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y,
  label AS cluster_id FROM embeddings""",
}


def with_base(sql: str, **extra: str) -> str:
    """``sql`` preceded by the base and extra CTEs it mentions, in dependency order."""
    known = {**CTES, **extra}
    needed: list[str] = []

    def visit_body(name: str, body: str) -> None:
        for other, inner in known.items():
            if other != name and other not in needed and re.search(rf"\b(FROM|JOIN)\s+{other}\b", body):
                visit_body(other, inner)
        if name not in needed:
            needed.append(name)

    for name, body in known.items():
        if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
            visit_body(name, body)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{name} AS ({known[name]})" for name in needed) + "\n" + sql

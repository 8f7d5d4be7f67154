"""Oracles of the investigator and institution cards, trends and agency portfolios."""

from oracles import fixed
from oracles.base import pct, rnd, scaled, with_base
from oracles.institute import YEARLY, slices, top

MPI = pct("count(*) FILTER (WHERE is_mpi)", "count(*)")
NO_INTERNAL = "activity NOT LIKE 'Z%' AND activity NOT LIKE 'N%'"
RAW_NAME = "trim(split_part(all_pis, '|', 1))"
CLEAN_NAME = (
    "trim(split_part(trim(regexp_replace(regexp_replace(all_pis, '\\(contact\\)', '', 'g'), '\\s+', ' ', 'g')), '|', 1))"
)


def person_cards(name, test, items):
    return with_base(
        f"""SELECT contact_pi_name, count(DISTINCT core_project_num) AS total_awards,
  {scaled('sum(total_lifetime_funding)', '1e6')} AS total_funding_millions,
  count(DISTINCT administering_ic) AS num_ics_funded_by, count(DISTINCT primary_org) AS num_institutions_worked,
  min(first_fiscal_year) AS career_start_year, max(last_fiscal_year) AS career_last_active_year,
  max(last_fiscal_year) - min(first_fiscal_year) AS career_span_years,
  sum(publication_count)::BIGINT AS total_publications, count(*) FILTER (WHERE is_mpi) AS total_mpi_awards,
  {MPI} AS pct_collaborative, {slices(items, '1e6')},
  coalesce(array_to_string(list_slice(list_sort(list(DISTINCT primary_org) FILTER (WHERE primary_org IS NOT NULL)),
    1, 5), ' | '), '') AS institutions,
  string_agg(DISTINCT administering_ic, ', ' ORDER BY administering_ic) AS ics_funded_by
FROM (SELECT * EXCLUDE (contact_pi_name), {name} AS contact_pi_name FROM award WHERE all_pis <> '')
WHERE {test} GROUP BY 1 HAVING total_awards >= 3"""
    )


HISTORY = f"""SELECT contact_pi_name, institution, min(fiscal_year) AS first_year_at_institution,
  max(fiscal_year) AS last_year_at_institution, count(DISTINCT fiscal_year) AS num_active_years,
  sum(k)::BIGINT AS total_awards_at_institution, {scaled('sum(f)', '1e6')} AS total_funding_millions
FROM (SELECT contact_pi_name, primary_org AS institution, fiscal_year, count(DISTINCT core_project_num) AS k,
    sum(part) AS f FROM yearly WHERE contact_pi_name IS NOT NULL AND fiscal_year BETWEEN 1985 AND 2024 GROUP BY ALL)
GROUP BY 1, 2"""
SHARED = f"""SELECT contact_pi_name AS pi, all_pi_names AS all_collaborators,
  count(DISTINCT core_project_num) AS num_collaborative_projects,
  count(DISTINCT administering_ic) AS num_ics_collaborated, count(DISTINCT cluster_label) AS num_topics_collaborated,
  min(fiscal_year) AS first_collaboration_year, max(fiscal_year) AS latest_collaboration_year,
  {scaled('sum(part)', '1e6')} AS total_collaborative_funding_millions
FROM yearly WHERE is_mpi AND contact_pi_name IS NOT NULL GROUP BY 1, 2"""
MIX = f"""SELECT contact_pi_name, {slices(fixed.PERSON_PORTFOLIO, '1e6')},
  min(first_fiscal_year) FILTER (WHERE activity IN ('K99', 'R00', 'K01', 'K08', 'K23', 'DP2')) AS first_early_career_award,
  min(first_fiscal_year) FILTER (WHERE activity IN ('R35', 'R37', 'P01')) AS first_senior_award
FROM clustered WHERE contact_pi_name IS NOT NULL AND first_fiscal_year <= least(last_fiscal_year, 2024) GROUP BY 1"""
IMPACT = f"""SELECT contact_pi_name, sum(publication_count)::BIGINT AS total_publications,
  NULL::BIGINT AS patent_count, NULL::VARCHAR AS patent_ids, NULL::BIGINT AS clinical_trial_count,
  NULL::VARCHAR AS clinical_trial_ids, NULL::VARCHAR AS orcid_id,
  {rnd('avg(publication_count)', 1)} AS avg_pubs_per_award
FROM clustered WHERE contact_pi_name IS NOT NULL GROUP BY 1"""
PERSON_BASE = f"""SELECT contact_pi_name, arg_max(primary_org, last_fiscal_year || core_project_num) AS unused,
  min(first_fiscal_year) AS career_start_year, max(last_fiscal_year) AS career_last_active_year,
  count(DISTINCT core_project_num) AS total_awards, {scaled('sum(total_lifetime_funding)', '1e6')} AS total_funding_millions,
  count(DISTINCT domain_id) AS num_research_domains, count(DISTINCT cluster_id) AS num_research_topics,
  count(DISTINCT administering_ic) AS num_funding_ics, count(*) FILTER (WHERE is_mpi) AS mpi_awards,
  {MPI} AS pct_collaborative
FROM clustered WHERE contact_pi_name IS NOT NULL GROUP BY 1"""
PEOPLE = {
    "yearly": YEARLY,
    "history": HISTORY,
    "shared": SHARED,
    "mix": MIX,
    "impact": IMPACT,
    "person_base": PERSON_BASE,
    "latest": """SELECT contact_pi_name, primary_org AS current_institution FROM clustered
QUALIFY row_number() OVER (PARTITION BY contact_pi_name ORDER BY last_fiscal_year DESC, core_project_num DESC) = 1""",
    "t_area": top("clustered", ["contact_pi_name"], "cluster_label", 5, "top_research_areas"),
    "t_area3": top("clustered", ["contact_pi_name"], "cluster_label", 3, "top_research_areas"),
    "t_dom": top("clustered", ["contact_pi_name"], "domain_name", 3, "top_domains"),
    "t_ic": top("clustered", ["contact_pi_name"], "administering_ic", 3, "top_funding_ics"),
    "t_act": top("clustered", ["contact_pi_name"], "activity", 5, "top_activity_codes"),
    "yearly_shared": "SELECT * FROM clustered WHERE is_mpi",
    "t_shared": top("yearly_shared", ["contact_pi_name", "all_pi_names"], "cluster_label", 5, "top_collaboration_topics"),
    "moves": """SELECT contact_pi_name, count(institution) AS moved,
  string_agg(institution || ':' || first_year_at_institution || ':' || last_year_at_institution || ':' || num_active_years,
    ' | ' ORDER BY first_year_at_institution, institution) AS institutional_history FROM history GROUP BY 1""",
    "shared_sum": """SELECT pi, sum(num_collaborative_projects)::BIGINT AS sp,
  sum(total_collaborative_funding_millions) AS sf FROM shared GROUP BY 1""",
}

OWN_LABS = """primary_org NOT LIKE '%NATIONAL INSTITUTE%' AND primary_org NOT LIKE '%NATIONAL CENTER FOR%'
  AND primary_org NOT LIKE '%DIVISION OF%NCI%' AND primary_org NOT LIKE '%DIVISION OF%NIH%'"""


def organization_cards(items, test="true"):
    return with_base(
        f"""SELECT b.*, t.* EXCLUDE (o) FROM (SELECT primary_org AS institution, primary_state AS state,
  count(DISTINCT core_project_num) AS total_awards, {scaled('sum(total_lifetime_funding)', '1e9')} AS total_funding_billions,
  count(DISTINCT administering_ic) AS num_ics, min(first_fiscal_year) AS earliest_year,
  max(last_fiscal_year) AS latest_year, sum(publication_count)::BIGINT AS total_publications,
  count(*) FILTER (WHERE is_mpi) AS total_mpi_awards, {MPI} AS pct_collaborative
 FROM award WHERE primary_org IS NOT NULL AND {test} GROUP BY 1, 2 HAVING total_awards >= 10) b
LEFT JOIN (SELECT primary_org AS o, {slices(items, '1e9')} FROM award
  WHERE primary_org IS NOT NULL AND {test} GROUP BY 1) t ON institution = o"""
    )


SPECIAL = f"""SELECT *, {pct('area_total_awards', 'total_awards')} AS pct_area,
  {pct('minority_serving_awards', 'total_awards')} AS pct_minority_serving,
  CASE WHEN ctsa_awards > 0 THEN 'Academic Medical Center' WHEN area_total_awards > 5 THEN 'Undergraduate-Focused'
    WHEN minority_serving_awards > 0 THEN 'Minority-Serving Institution'
    WHEN specialized_center_awards >= 3 THEN 'Specialized Research Center' ELSE 'Research University' END AS institution_type
FROM (SELECT primary_org AS institution, count(*) AS total_awards,
  {scaled('sum(total_lifetime_funding)', '1e9')} AS total_funding_billions, {slices(fixed.ORGANIZATION_SPECIAL, '1e6')}
  FROM clustered WHERE primary_org IS NOT NULL GROUP BY 1)"""
OFFICES = f"""SELECT *, row_number() OVER (PARTITION BY institution ORDER BY dept_funding_millions DESC, department)::INTEGER
  AS dept_funding_rank FROM (SELECT primary_org AS institution, org_dept AS department,
  count(DISTINCT core_project_num) AS dept_awards, {scaled('sum(total_lifetime_funding)', '1e6')} AS dept_funding_millions,
  count(DISTINCT contact_pi_name) AS dept_active_pis, count(DISTINCT domain_id) AS dept_domains,
  count(DISTINCT cluster_id) AS dept_topics, min(first_fiscal_year) AS dept_first_year,
  max(last_fiscal_year) AS dept_last_year, count(*) FILTER (WHERE is_mpi) AS dept_mpi_awards,
  {MPI} AS dept_pct_collaborative, sum(publication_count)::BIGINT AS dept_publications
  FROM clustered WHERE primary_org IS NOT NULL AND org_dept <> '' GROUP BY 1, 2)"""
ORG_BASE = f"""SELECT primary_org AS institution, count(DISTINCT core_project_num) AS total_awards,
  {scaled('sum(total_lifetime_funding)', '1e9')} AS total_funding_billions, count(DISTINCT domain_id) AS num_domains,
  count(DISTINCT cluster_id) AS num_topics, count(DISTINCT contact_pi_name) AS total_unique_pis,
  min(first_fiscal_year) AS first_award_year, max(last_fiscal_year) AS last_award_year,
  count(*) FILTER (WHERE is_mpi) AS total_mpi_awards, {MPI} AS pct_collaborative,
  sum(publication_count)::BIGINT AS total_publications, {rnd('avg(publication_count)', 1)} AS avg_pubs_per_award,
  count(DISTINCT administering_ic) AS num_funding_ics, {slices(fixed.ORGANIZATION_COMPLETE, '1e9')}
FROM clustered WHERE primary_org IS NOT NULL GROUP BY 1"""
ORGS = {
    "yearly": YEARLY,
    "special": SPECIAL,
    "offices": OFFICES,
    "org_base": ORG_BASE,
    "inst": "SELECT *, primary_org AS institution, org_dept AS department FROM clustered WHERE primary_org IS NOT NULL",
    "year_inst": """SELECT *, primary_org AS institution FROM yearly
WHERE primary_org IS NOT NULL AND fiscal_year BETWEEN 1985 AND 2024""",
    "t_topics": top("inst", ["institution"], "cluster_label", 10, "top_topics"),
    "t_domains": top("inst", ["institution"], "domain_name", 5, "top_domains"),
    "t_dept": top("inst", ["institution", "department"], "cluster_label", 3, "dept_top_topics"),
    "t_year": top("year_inst", ["institution", "fiscal_year"], "cluster_label", 5, "top_topics_this_year"),
    "best_offices": """SELECT institution, count(*) AS num_departments_with_funding,
  string_agg(department || ':' || dept_awards || ':' || dept_active_pis, ' | ' ORDER BY dept_funding_rank)
    FILTER (WHERE dept_funding_rank <= 10) AS top_departments FROM offices GROUP BY 1""",
    "places": """SELECT institution, min(primary_state) AS state, min(org_city) AS city, min(org_country) AS country
FROM inst GROUP BY 1""",
}
FUNDED = """SELECT *, array_to_string(years, ', ') AS fiscal_years_funded,
  unnest(range(first_fiscal_year, last_fiscal_year + 1))::INTEGER AS fiscal_year,
  total_lifetime_funding::DOUBLE / distinct_fiscal_years AS part FROM award"""
TRENDS = with_base(
    f"""SELECT fiscal_year, count(DISTINCT core_project_num) AS total_awards,
  {scaled('sum(part)', '1e9')} AS total_funding_billions, {slices(fixed.PORTFOLIO_YEAR, '1e9', 'part')}
FROM funded WHERE contains(fiscal_years_funded, fiscal_year::VARCHAR) AND fiscal_year BETWEEN 2000 AND 2024 GROUP BY 1""",
    funded=FUNDED,
)

SQL = {
    "pi_cards_comprehensive": person_cards(RAW_NAME, "true", fixed.PERSON),
    "pi_cards_cleaned_names": person_cards(
        CLEAN_NAME, "contact_pi_name NOT IN ('', 'TBD, TBD')", fixed.PERSON_ALL_MECHANISMS
    ),
    "pi_cards_external_mechanisms": person_cards(
        CLEAN_NAME,
        f"contact_pi_name NOT IN ('', 'TBD, TBD') AND contact_pi_name NOT LIKE '%,%  %' AND {NO_INTERNAL}",
        fixed.PERSON,
    ),
    "pi_institutional_history": with_base("SELECT * FROM history", **PEOPLE),
    "pi_collaborations": with_base(
        """SELECT shared.*, top_collaboration_topics FROM shared
LEFT JOIN t_shared ON pi = contact_pi_name AND all_collaborators = all_pi_names""",
        **PEOPLE,
    ),
    "pi_award_portfolio": with_base("SELECT mix.*, top_activity_codes FROM mix LEFT JOIN t_act USING (contact_pi_name)", **PEOPLE),
    "pi_broader_impact": with_base("SELECT * FROM impact", **PEOPLE),
    "pi_cards_complete": with_base(
        f"""SELECT person_base.* EXCLUDE (unused), current_institution, top_research_areas, top_domains, top_funding_ics,
  institutional_history, coalesce(moved, 1) AS num_institutions_worked, mix.* EXCLUDE (contact_pi_name),
  top_activity_codes, coalesce(sp, 0) AS collaborative_project_count,
  {rnd('coalesce(sf, 0)')} AS collaborative_funding_m, total_publications, avg_pubs_per_award, patent_count,
  clinical_trial_count, orcid_id, career_last_active_year - career_start_year AS career_span_years,
  {rnd('total_funding_millions / total_awards')} AS avg_funding_per_award
FROM person_base LEFT JOIN latest USING (contact_pi_name) LEFT JOIN t_area USING (contact_pi_name)
  LEFT JOIN t_dom USING (contact_pi_name) LEFT JOIN t_ic USING (contact_pi_name)
  LEFT JOIN moves USING (contact_pi_name) LEFT JOIN mix USING (contact_pi_name) LEFT JOIN t_act USING (contact_pi_name)
  LEFT JOIN shared_sum ON contact_pi_name = pi LEFT JOIN impact USING (contact_pi_name)
WHERE total_awards >= 3 ORDER BY total_funding_millions DESC, contact_pi_name LIMIT 1000""",
        **PEOPLE,
    ),
    "top_pis": with_base(
        f"""SELECT *, split_part(top_research_areas, ':', 1) AS top_area,
  {rnd('total_citations / nullif(total_publications, 0)', 1)} AS avg_citations_per_pub,
  career_last_active - career_start AS career_span_years,
  {rnd('funding_millions / total_awards')} AS avg_funding_per_award
FROM (SELECT contact_pi_name, min(primary_org) AS primary_institution, count(DISTINCT core_project_num) AS total_awards,
  {scaled('sum(total_lifetime_funding)', '1e6')} AS funding_millions, sum(publication_count)::BIGINT AS total_publications,
  sum(citation_count)::BIGINT AS total_citations, count(DISTINCT domain_id) AS num_domains,
  count(DISTINCT cluster_id) AS num_topics, min(first_fiscal_year) AS career_start,
  max(last_fiscal_year) AS career_last_active, count(*) FILTER (WHERE is_mpi) AS mpi_awards
  FROM clustered WHERE contact_pi_name IS NOT NULL GROUP BY 1 HAVING total_awards >= 3)
LEFT JOIN t_area3 USING (contact_pi_name) LEFT JOIN t_ic USING (contact_pi_name)
ORDER BY funding_millions DESC, contact_pi_name LIMIT 100""",
        **PEOPLE,
    ),
    "institution_cards_comprehensive": organization_cards(fixed.ORGANIZATION),
    "institution_cards_external": organization_cards(fixed.ORGANIZATION_ALL_MECHANISMS, OWN_LABS),
    "institution_cards_external_mechanisms": organization_cards(fixed.ORGANIZATION, f"{OWN_LABS} AND {NO_INTERNAL}"),
    "institution_departments": with_base(
        "SELECT offices.*, dept_top_topics FROM offices LEFT JOIN t_dept USING (institution, department)", **ORGS
    ),
    "institution_temporal_trends": with_base(
        f"""SELECT y.*, top_topics_this_year FROM (SELECT institution, fiscal_year,
  count(DISTINCT core_project_num) AS num_awards, {scaled('sum(part)', '1e6')} AS funding_millions,
  count(DISTINCT contact_pi_name) AS num_active_pis, {slices(fixed.ORGANIZATION_YEARLY, '1e6', 'part')}
 FROM year_inst GROUP BY 1, 2) y LEFT JOIN t_year USING (institution, fiscal_year)""",
        **ORGS,
    ),
    "institution_specialization": with_base("SELECT * FROM special", **ORGS),
    "institution_geography": with_base(
        f"""SELECT institution, primary_state AS state, org_city AS city, org_country AS country, org_zipcode AS zipcode,
  count(DISTINCT core_project_num) AS awards_in_location,
  {scaled('sum(total_lifetime_funding)', '1e6')} AS funding_millions, count(DISTINCT contact_pi_name) AS pis_in_location
FROM inst GROUP BY 1, 2, 3, 4, 5""",
        **ORGS,
    ),
    "institution_cards_complete": with_base(
        """SELECT org_base.*, top_domains, top_topics, num_departments_with_funding, top_departments,
  institution_type, area_total_awards, area_total_funding_m, pct_area, minority_serving_awards, pct_minority_serving,
  ctsa_awards, specialized_center_awards, state, city, country
FROM org_base LEFT JOIN t_domains USING (institution) LEFT JOIN t_topics USING (institution)
  LEFT JOIN best_offices USING (institution) LEFT JOIN special USING (institution) LEFT JOIN places USING (institution)
WHERE org_base.total_awards >= 10 ORDER BY org_base.total_funding_billions DESC, institution LIMIT 500""",
        **ORGS,
    ),
    "top_institutions": with_base(
        """SELECT institution AS institution_name, total_awards, total_funding_billions AS funding_billions, num_domains,
  num_topics, total_unique_pis AS num_contact_pis, total_publications, avg_pubs_per_award,
  total_mpi_awards AS mpi_awards, pct_collaborative, num_funding_ics, first_award_year, last_award_year,
  top_domains AS top_research_domains, split_part(top_domains, ':', 1) AS top_domain
FROM org_base LEFT JOIN t_domains USING (institution) WHERE total_awards >= 10
ORDER BY total_funding_billions DESC, institution LIMIT 50""",
        **ORGS,
    ),
    "temporal_trends_comprehensive": TRENDS,
    "temporal_trends_recent": f"SELECT * FROM ({TRENDS}) WHERE fiscal_year >= 2015",
    "awards_with_agency": with_base(
        """SELECT core_project_num, administering_ic, ic_full_name, funding_agency, ic_type, department,
  organizational_category FROM agency_award"""
    ),
    "portfolio_by_agency": with_base(
        f"""SELECT department, funding_agency, organizational_category, count(*) AS num_awards,
  count(DISTINCT administering_ic) AS num_ics, {scaled('sum(total_lifetime_funding)', '1e9')} AS funding_billions,
  {rnd('avg(publication_count)', 1)} AS avg_pubs, count(*) FILTER (WHERE is_mpi) AS mpi_awards, {MPI} AS pct_mpi,
  min(first_fiscal_year) AS earliest_year, max(last_fiscal_year) AS latest_year FROM agency_award GROUP BY 1, 2, 3"""
    ),
    "portfolio_by_ic_detailed": with_base(
        f"""SELECT unit_department AS department, unit_agency AS funding_agency, unit_type AS ic_type, administering_ic,
  unit_name AS ic_name, organizational_category, count(*) AS num_awards,
  {scaled('sum(total_lifetime_funding)', '1e9')} AS funding_billions, {rnd('avg(publication_count)', 1)} AS avg_pubs,
  {rnd('avg(pi_count)', 2)} AS avg_pi_count, count(*) FILTER (WHERE is_mpi) AS mpi_awards, {MPI} AS pct_mpi,
  any_value(top_mechanisms) AS top_mechanisms
FROM agency_award JOIN units ON administering_ic = ic_code LEFT JOIN t_mech USING (administering_ic)
GROUP BY 1, 2, 3, 4, 5, 6""",
        t_mech=top("award", ["administering_ic"], "activity", 5, "top_mechanisms"),
    ),
}

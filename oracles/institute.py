"""Oracles of the funding-unit cards."""

from oracles import fixed
from oracles.base import in_list, pct, rnd, scaled, with_base

YEARLY = """SELECT c.*, total_lifetime_funding::DOUBLE / greatest(1, last_fiscal_year - first_fiscal_year + 1) AS part,
  unnest(range(first_fiscal_year, last_fiscal_year + 1))::INTEGER AS fiscal_year FROM clustered c"""


def slices(items, unit, amount="total_lifetime_funding", outer=""):
    """Count and funding columns of a mechanism breakdown."""
    found = []
    for item in items:
        test = in_list(item.family)
        found.append(f"count(*) FILTER (WHERE {test}) AS {item.count}")
        if item.funding:
            found.append(scaled(f"coalesce(sum({amount}) FILTER (WHERE {test}), 0)", unit) + f" AS {item.funding}")
    return ",\n  ".join(found)


def top(source, keys, value, k, name, extra=""):
    """CTE body listing the k most frequent values per key as text."""
    keyed = ", ".join(keys)
    return f"""SELECT {keyed}, string_agg(v || ':' || n, ' | ' ORDER BY p) AS {name} FROM (
  SELECT *, row_number() OVER (PARTITION BY {keyed} ORDER BY n DESC, v) AS p FROM (
    SELECT {keyed}, {value} AS v, count(*) AS n FROM {source} WHERE {value} IS NOT NULL {extra} GROUP BY ALL))
  WHERE p <= {k} GROUP BY {keyed}"""


def comprehensive(items, lean):
    base = "" if lean else (
        f"sum(total_lifetime_funding)::DOUBLE AS total_funding, {rnd('avg(publication_count)', 1)} AS avg_pubs_per_award,"
    )
    return with_base(
        f"""SELECT b.*, t.* EXCLUDE (ic) FROM
(SELECT administering_ic, ic_name, agency, count(DISTINCT core_project_num) AS total_projects,
  {scaled('sum(total_lifetime_funding)', '1e9')} AS total_funding_billions, {base}
  count(DISTINCT primary_org) AS total_institutions, count(*) FILTER (WHERE is_mpi) AS total_mpi_awards,
  {pct('count(*) FILTER (WHERE is_mpi)', 'count(*)')} AS pct_mpi,
  sum(publication_count)::BIGINT AS total_publications,
  min(first_fiscal_year) AS earliest_year, max(last_fiscal_year) AS latest_year
 FROM award WHERE administering_ic IS NOT NULL GROUP BY ALL) b
LEFT JOIN (SELECT administering_ic AS ic, {slices(items, '1e9')} FROM award GROUP BY 1) t ON administering_ic = ic"""
    )


FULL = comprehensive(fixed.UNIT, False)
LEAN = comprehensive(fixed.UNIT_ALL_MECHANISMS, True)
PER_UNIT = f"""SELECT administering_ic, organizational_category, count(DISTINCT core_project_num) AS total_awards,
  {scaled('sum(total_lifetime_funding)', '1e9')} AS total_funding_billions,
  count(DISTINCT domain_id) AS num_domains, count(DISTINCT cluster_id) AS num_topics,
  count(DISTINCT contact_pi_name) AS total_unique_pis, count(DISTINCT primary_org) AS total_institutions,
  sum(publication_count)::BIGINT AS total_publications, {rnd('avg(publication_count)', 1)} AS avg_pubs_per_award,
  count(*) FILTER (WHERE is_mpi) AS total_mpi_awards, {pct('count(*) FILTER (WHERE is_mpi)', 'count(*)')} AS pct_mpi,
  {rnd('avg(pi_count)', 2)} AS avg_pis_per_award, min(first_fiscal_year) AS earliest_year,
  max(last_fiscal_year) AS latest_year
FROM agency_award WHERE cluster_id IS NOT NULL GROUP BY 1, 2"""
UNIT_TYPES = f"SELECT administering_ic AS ic, {slices(fixed.UNIT_COMPLETE, '1e9')} FROM clustered GROUP BY 1"
KEYS = ("administering_ic", "organizational_category")
CLUSTERED_AGENCY = "SELECT * FROM agency_award WHERE cluster_id IS NOT NULL"
CARD_PARTS = {
    "yearly": YEARLY,
    "per_unit": PER_UNIT,
    "unit_types": UNIT_TYPES,
    "clustered_agency": CLUSTERED_AGENCY,
    "top_d": top("clustered_agency", KEYS, "domain_name", 5, "top_domains"),
    "top_c": top("clustered_agency", KEYS, "cluster_label", 10, "top_clusters"),
    "top_y": top(
        "yearly", ("administering_ic", "fiscal_year"), "cluster_label", 5, "top_topics",
        "AND fiscal_year BETWEEN 1985 AND 2024",
    ),
}

SQL = {
    "ic_cards_comprehensive": FULL,
    "ic_cards_all_mechanisms": LEAN,
    "ic_cards_trimmed": f"""SELECT * FROM ({LEAN}) WHERE administering_ic IS NULL OR administering_ic NOT IN
  ({', '.join(f"'{c}'" for c in fixed.SPELLED_OUT_UNITS)})""",
    "ic_mechanism_shares": f"""SELECT administering_ic, ic_name, total_projects, total_funding_billions,
  rpg_standard_count, centers_p_count, coop_agreements_u_count, training_t_count, career_dev_count, fellowship_count,
  {pct('rpg_standard_funding_b', 'total_funding_billions')} AS pct_rpg,
  {pct('centers_p_funding_b', 'total_funding_billions')} AS pct_centers,
  {pct('coop_agreements_u_funding_b', 'total_funding_billions')} AS pct_coop_agreements,
  ul1_ctsa, t32_institutional_training
FROM ({FULL}) ORDER BY total_funding_billions DESC, administering_ic LIMIT 15""",
    "ic_temporal_trends": with_base(
        f"""SELECT y.*, top_topics FROM (SELECT administering_ic, fiscal_year,
  count(DISTINCT core_project_num) AS num_awards, {scaled('sum(part)', '1e6')} AS funding_millions,
  sum(publication_count)::BIGINT AS num_publications, count(DISTINCT contact_pi_name) AS num_unique_pis,
  count(DISTINCT primary_org) AS num_institutions,
  count(*) FILTER (WHERE activity IN ('R21', 'R03', 'K99', 'R00', 'DP2')) AS num_likely_esi_ni,
  {slices(fixed.UNIT_TREND, '1e6', 'part')},
  count(*) FILTER (WHERE is_mpi) AS mpi_awards, {rnd('avg(pi_count)', 2)} AS avg_pis_per_award
 FROM yearly WHERE fiscal_year BETWEEN 1985 AND 2024 GROUP BY 1, 2) y
LEFT JOIN top_y USING (administering_ic, fiscal_year)""",
        **CARD_PARTS,
    ),
    "ic_cards_complete": with_base(
        """SELECT per_unit.*, top_domains, top_clusters, unit_types.* EXCLUDE (ic) FROM per_unit
LEFT JOIN unit_types ON administering_ic = ic
LEFT JOIN top_d USING (administering_ic, organizational_category)
LEFT JOIN top_c USING (administering_ic, organizational_category)""",
        **CARD_PARTS,
    ),
    "ic_active_periods": with_base(
        """SELECT administering_ic, total_funding_billions, total_awards, total_unique_pis, total_institutions,
  earliest_year || '-' || latest_year AS active_period, unit_types.* EXCLUDE (ic, COLUMNS('.*funding_b'))
FROM per_unit LEFT JOIN unit_types ON administering_ic = ic
ORDER BY total_funding_billions DESC, administering_ic LIMIT 10""".replace(
            "unit_types.* EXCLUDE (ic, COLUMNS('.*funding_b'))",
            ", ".join(item.count for item in fixed.UNIT_COMPLETE),
        ),
        **CARD_PARTS,
    ),
    "ic_summary": with_base(
        """SELECT administering_ic, organizational_category, total_awards, total_funding_billions AS funding_billions,
  num_domains, num_topics, total_institutions AS num_institutions, total_publications, avg_pubs_per_award,
  total_mpi_awards AS mpi_awards, pct_mpi, avg_pis_per_award, earliest_year, latest_year FROM per_unit""",
        **CARD_PARTS,
    ),
}

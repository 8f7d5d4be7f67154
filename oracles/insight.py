"""Oracles of terms, labels, quality and maps."""

from oracles import fixed
from oracles.base import listing, rnd, with_base
from oracles.portfolio import POINT_KEY, POINTS


def capital(text):
    """Each blank-separated word with a capital first letter."""
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def terms_of(column):
    return f"list_filter(list_transform(string_split({column}, ';'), lambda t: lower(trim(t))), lambda t: t <> '')"


IRREGULAR = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in fixed.IRREGULAR.items()) + "}"
LEMMA = f"""CASE WHEN {IRREGULAR}[w] IS NOT NULL THEN {IRREGULAR}[w]
  WHEN regexp_matches(w, '[a-z][a-z]ies$') THEN w[:-4] || 'y'
  WHEN regexp_matches(w, '(ss|x|z|ch|sh)es$') THEN w[:-3]
  WHEN regexp_matches(w, '[^su i]s$') AND length(w) > 3 THEN w[:-2] ELSE w END"""


def lemmas(terms):
    return f"""list_transform({terms}, lambda t: array_to_string(list_transform(string_split(t, ' '), lambda w: {LEMMA}), ' '))"""


def kept(terms, stops):
    return f"array_to_string(list_filter({terms}, lambda t: NOT list_contains({listing(stops)}, t) AND length(t) >= 4), ' ')"


def top_terms(group, limit, expression, source="point"):
    """Most frequent terms per group with their rank."""
    return f"""SELECT {group}, term, n, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, term) AS p FROM (
  SELECT {group}, term, count(*) AS n FROM (SELECT {group}, unnest({expression}) AS term FROM {source}) GROUP BY 1, 2)
QUALIFY p <= {limit}"""


def inherited(level, per_cluster, limit):
    return f"""SELECT {level}, term, sum(n) AS n, row_number() OVER (PARTITION BY {level} ORDER BY sum(n) DESC, term) AS p
FROM (SELECT {level}, cluster, count(*) AS n FROM point GROUP BY 1, 2) JOIN
  (SELECT cluster, term FROM cluster_terms WHERE p <= {per_cluster}) USING (cluster) GROUP BY 1, 2 QUALIFY p <= {limit}"""


CAT = "list_filter(list_transform(string_split(categories, ';'), lambda t: trim(t)), lambda t: t <> '')"
TERM_LIST = terms_of("terms")
WORD_RUNS = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower(title), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 2 AND w <> 'in')"
GRAMS = """list_concat(w, list_concat(
  list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]),
  list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))"""


def rules(items, other):
    branches = " ".join(f"WHEN regexp_matches(j, '{pattern}') THEN '{name}'" for name, pattern in items)
    return f"CASE {branches} ELSE '{other}' END"


def specific(window, words, joiner, generic, cut):
    text = capital(f"""array_to_string(list_slice(CASE WHEN len(s) > 0 THEN s ELSE a END, 1, {words}), '{joiner}')""")
    text = f"substr({text}, 1, {cut})" if cut else text
    return with_base(
        f"""SELECT topic, CASE WHEN len(a) > 0 THEN {text} ELSE category END AS label FROM
  (SELECT DISTINCT domain, topic FROM point) JOIN categories USING (domain) LEFT JOIN
  (SELECT topic, list(term ORDER BY p) AS a, coalesce(list(term ORDER BY p)
    FILTER (WHERE NOT list_contains({listing(generic)}, lower(term))), []) AS s FROM topic_terms WHERE p <= {window} GROUP BY 1)
  USING (topic)""",
        **INSIGHT,
    )


INSIGHT = {
    **POINTS,
    "cluster_terms": top_terms("cluster", 20, TERM_LIST),
    "label_terms": top_terms("cluster", 20, f"list_filter({TERM_LIST}, lambda t: length(t) > 3)"),
    "title_terms": f"""SELECT cluster, term, n, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) AS p FROM (
  SELECT cluster, term, count(*) AS n FROM (SELECT cluster, unnest(list_concat(w, list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT cluster, {WORD_RUNS} AS w FROM point)) GROUP BY 1, 2)
QUALIFY p <= 5""",
    "domain_cats": top_terms("domain", 2, CAT),
    "topic_cats": top_terms("topic", 1, CAT),
    "subtopic_cats": top_terms("subtopic", 1, CAT),
    "cluster_cats": top_terms("cluster", 3, CAT),
    "domain_named": """SELECT domain, CASE WHEN count(*) > 1 THEN max(substr(term, 1, 25)) FILTER (WHERE p = 1) || ' & ' ||
  max(substr(term, 1, 25)) FILTER (WHERE p = 2) ELSE max(substr(term, 1, 50)) END AS domain_label FROM domain_cats GROUP BY 1""",
    "domain_terms": inherited("domain", 5, 10),
    "topic_terms": inherited("topic", 5, 20),
    "subtopic_terms": inherited("subtopic", 8, 10),
    "categories": f"""SELECT domain, {rules(fixed.DOMAIN_KEYWORDS, fixed.OTHER_CATEGORY)} AS category,
  long_category FROM (SELECT domain, lower(string_agg(term, '; ' ORDER BY p)) AS j FROM domain_terms GROUP BY 1) JOIN
  (SELECT domain, {rules(fixed.DOMAIN_KEYWORDS_LONG, fixed.OTHER_CATEGORY_LONG)} AS long_category FROM
    (SELECT domain, lower(string_agg(term, '; ' ORDER BY p)) AS j FROM domain_terms WHERE p <= 8 GROUP BY 1))
  USING (domain)""",
    "sub_sizes": "SELECT topic, subtopic, count(*) AS size FROM point GROUP BY 1, 2",
    "sub_ranked": "SELECT *, count(*) OVER (PARTITION BY topic, term) AS holders FROM subtopic_terms JOIN sub_sizes USING (subtopic)",
    "words": """SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'),
  lambda t: regexp_matches(t, '^[a-z]{4,}$')) AS w FROM documents""",
    "tf": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({GRAMS}) AS term FROM words) GROUP BY 1, 2",
    "vocab": """SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM tf
GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.4::DOUBLE * (SELECT count(*) FROM documents)
ORDER BY sum(tf) DESC, term LIMIT 500""",
    "weights": """SELECT doc_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS weight
FROM tf JOIN vocab USING (term)""",
    "dims": "SELECT vec_id, cluster_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM vec",
    "unit_dims": """SELECT vec_id, cluster_id, d, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM dims""",
    "centre_dims": "SELECT cluster_id, d, avg(v) AS c FROM dims GROUP BY 1, 2",
    "centre_sizes": "SELECT cluster_id, count(*) AS size FROM vec GROUP BY 1",
    "own_gap": """SELECT vec_id, cluster_id, sum((v - c) ** 2) AS g FROM dims JOIN centre_dims USING (cluster_id, d) GROUP BY 1, 2""",
    "scatter": "SELECT cluster_id, avg(sqrt(g)) AS s, sum(g) AS w FROM own_gap GROUP BY 1",
    "centre_gap": """SELECT a.cluster_id AS i, b.cluster_id AS j, sqrt(sum((a.c - b.c) ** 2)) AS g
FROM centre_dims a JOIN centre_dims b ON a.d = b.d AND a.cluster_id <> b.cluster_id GROUP BY 1, 2""",
    "between": """SELECT sum(size * (c - o) ** 2) AS b FROM centre_dims JOIN centre_sizes USING (cluster_id)
JOIN (SELECT d, avg(v) AS o FROM dims GROUP BY 1) USING (d)""",
}


def silhouette(measure, source):
    return f"""SELECT '{measure}' AS measure, round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
FROM (SELECT vec_id, own, max(size) FILTER (WHERE cluster_id = own) AS size,
    max(dist * size / (size - 1)) FILTER (WHERE cluster_id = own) AS a, min(dist) FILTER (WHERE cluster_id <> own) AS b
  FROM (SELECT x.vec_id, x.cluster_id AS own, s.cluster_id, n AS size,
      max(xx) + max(psi) / n - 2 * sum(v * y) / n AS dist
    FROM (SELECT *, sum(v * v) OVER (PARTITION BY vec_id) AS xx FROM {source}) x
    JOIN (SELECT cluster_id, d, sum(v) AS y, sum(sum(v * v)) OVER (PARTITION BY cluster_id) AS psi,
        count(*) AS n FROM {source} GROUP BY 1, 2) s USING (d) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)"""


PAIRS = "n::DOUBLE * (n - 1) / 2"
SQL = {
    "cleaned_terms": with_base(
        f"""SELECT core_project_num, {kept(terms_of("coalesce(project_terms, '')"), fixed.STOP_TERMS)} AS cleaned,
  {kept(lemmas(terms_of("coalesce(project_terms, '')")), fixed.STOP_LEMMAS)} AS lemmatized FROM award"""
    ),
    "term_document_frequency": with_base(
        f"""SELECT term, count(*) AS documents FROM (SELECT unnest(list_distinct({lemmas(TERM_LIST)})) AS term FROM point)
GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= 0.4::DOUBLE * (SELECT count(*) FROM point)"""
    ),
    "kept_science_terms": with_base(
        f"""SELECT domain, term, count(*) AS n FROM (SELECT domain, unnest({TERM_LIST}) AS term FROM point)
WHERE list_has_any(string_split(term, ' '), ['ring', 'gear', 'bolt', 'panel']) GROUP BY 1, 2"""
    ),
    "document_term_weights": with_base(f"SELECT doc_id, term, {rnd('weight', 6)} AS weight FROM weights", **INSIGHT),
    "strongest_document_terms": with_base(
        f"""SELECT term, {rnd('sum(weight) / (SELECT count(*) FROM documents)', 6)} AS mean_weight FROM weights
GROUP BY 1 ORDER BY mean_weight DESC, term LIMIT 20""",
        **INSIGHT,
    ),
    "cluster_term_labels": with_base(
        """SELECT cluster, CASE WHEN count(term) >= 3 THEN string_agg(term, ' / ' ORDER BY p) FILTER (WHERE p <= 3)
  ELSE 'Topic ' || cluster END AS label, coalesce(string_agg(term, '; ' ORDER BY p) FILTER (WHERE p <= 5), '') AS top_terms
FROM (SELECT DISTINCT cluster FROM point) LEFT JOIN label_terms USING (cluster) GROUP BY 1""",
        **INSIGHT,
    ),
    "cluster_title_labels": with_base(
        f"""SELECT cluster, CASE WHEN count(term) > 0 THEN
  {capital("array_to_string(list_slice(list_sort(list(term)), 1, 3), ' & ')")} ELSE 'Cluster ' || cluster END AS label,
  coalesce(string_agg(term, ', ' ORDER BY term), '') AS keywords
FROM (SELECT DISTINCT cluster FROM point) LEFT JOIN title_terms USING (cluster) GROUP BY 1""",
        **INSIGHT,
    ),
    "hierarchy_category_labels": with_base(
        """SELECT domain, topic, subtopic, domain_label, topic_label,
  substr(topic_label, 1, 30) || '... > ' || coalesce(substr(s.term, 1, 30), 'Subtopic ' || subtopic) AS subtopic_label
FROM (SELECT DISTINCT domain, topic, subtopic, domain_label,
    substr(domain_label, 1, 20) || ' > ' || coalesce(substr(t.term, 1, 40), 'Topic ' || topic) AS topic_label
  FROM (SELECT DISTINCT domain, topic, subtopic FROM point) JOIN domain_named USING (domain) LEFT JOIN topic_cats t USING (topic))
LEFT JOIN subtopic_cats s USING (subtopic)""",
        **INSIGHT,
    ),
    "cluster_unit_category_labels": with_base(
        """SELECT l.cluster, lead_ic || ': ' || coalesce(CASE WHEN length(term) > 35 THEN substr(term, 1, 32) || '...' ELSE term END,
  'General Research') AS label FROM leads l LEFT JOIN (SELECT * FROM cluster_cats WHERE p = 1) c ON l.cluster = c.cluster""",
        **INSIGHT,
    ),
    "cluster_three_category_labels": with_base(
        """SELECT cluster, coalesce(string_agg(term, ' | ' ORDER BY p), 'Topic ' || cluster) AS label
FROM sizes LEFT JOIN cluster_cats USING (cluster) GROUP BY 1""",
        **INSIGHT,
    ),
    "topic_specific_labels": specific(15, 2, " / ", fixed.GENERIC_TERMS, 50),
    "topic_specific_labels_long": specific(20, 3, " and ", fixed.GENERIC_DOMAIN_TERMS, None),
    "domain_keyword_categories": with_base("SELECT domain, category, long_category FROM categories", **INSIGHT),
    "subtopic_distinctive_labels": with_base(
        f"""SELECT subtopic, topic, size, {capital('''coalesce(
  array_to_string(list_slice(list(term ORDER BY p) FILTER (WHERE holders = 1), 1, 2), ' & '),
  max(term) FILTER (WHERE p = 1))''')} AS label FROM sub_ranked GROUP BY 1, 2, 3""",
        **INSIGHT,
    ),
    "vector_silhouette": with_base(
        silhouette("squaredEuclidean", "dims") + " UNION ALL " + silhouette("cosine", "unit_dims"), **INSIGHT
    ),
    "vector_separation": with_base(
        f"""SELECT k, n, {rnd('(b / (k - 1)) / (w / (n - k))', 6)} AS calinski_harabasz,
  {rnd('(SELECT avg(m) FROM (SELECT i, max((x.s + y.s) / g) AS m FROM centre_gap JOIN scatter x ON i = x.cluster_id JOIN scatter y ON j = y.cluster_id GROUP BY 1))', 6)} AS davies_bouldin
FROM (SELECT count(*) AS k, sum(size)::BIGINT AS n FROM centre_sizes) CROSS JOIN between
CROSS JOIN (SELECT sum(w) AS w FROM scatter)""",
        **INSIGHT,
    ),
    "labeling_agreement": with_base(
        f"""SELECT {rnd('(ij - i * j / t) / ((i + j) / 2 - i * j / t)', 6)} AS adjusted_rand FROM (SELECT
  (SELECT sum({PAIRS}) FROM (SELECT count(*) AS n FROM point GROUP BY cluster, topic)) AS ij,
  (SELECT sum({PAIRS}) FROM (SELECT count(*) AS n FROM point GROUP BY cluster)) AS i,
  (SELECT sum({PAIRS}) FROM (SELECT count(*) AS n FROM point GROUP BY topic)) AS j,
  (SELECT {PAIRS} FROM (SELECT count(*) AS n FROM point)) AS t)"""
    ),
    "mean_unit_purity": with_base(
        f"""SELECT count(*) AS clusters, {rnd('avg(n::DOUBLE / size)', 6)} AS mean_purity,
  {rnd('1.0::DOUBLE / (SELECT count(DISTINCT ic) FROM point)', 6)} AS random_baseline FROM leads JOIN sizes USING (cluster)""",
        **INSIGHT,
    ),
    "pairwise_variation": with_base(
        f"""SELECT count(*) AS pairs, {rnd('avg(d)', 6)} AS mean, {rnd('stddev_pop(d)', 6)} AS std,
  {rnd('stddev_pop(d) / avg(d)', 6)} AS cv FROM (SELECT 1 - list_cosine_similarity(a.embedding, b.embedding) AS d
  FROM vec a JOIN vec b ON a.vec_id < b.vec_id)"""
    ),
    "topic_quality_scores": with_base(
        f"""SELECT topic, sum(n)::BIGINT AS n_grants, count(*) AS n_ics,
  -{rnd('sum((n * n)::DOUBLE) / (sum(n) * sum(n))::DOUBLE', 6)} AS neg_hhi, max(high) - min(low) AS year_span,
  {rnd('sum(c)::DOUBLE / sum(k)')} AS avg_funding, (CASE WHEN sum(n) < 100 THEN 100 ELSE 0 END
  + CASE WHEN count(*) > 25 THEN count(*) ELSE 0 END + CASE WHEN sum(n) = 1 THEN 1000 ELSE 0 END)::BIGINT AS quality_score,
  string_agg(ic || ':' || n, ' | ' ORDER BY p) FILTER (WHERE p <= 3) AS top_3_ics
FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, ic) AS p FROM (SELECT topic, ic, count(*) AS n,
  sum(cost) AS c, count(cost) AS k, min(fy) AS low, max(fy) AS high FROM point GROUP BY 1, 2)) GROUP BY 1"""
    ),
    "cluster_size_diversity": with_base(
        "SELECT cluster, size, ics AS units, size < 100 AS is_small, ics > 25 AS is_generic FROM sizes", **INSIGHT
    ),
    "map_spread": with_base(
        f"""SELECT max(x) - min(x) AS x_range, max(y) - min(y) AS y_range,
  {rnd('(max(x) - min(x)) / (max(y) - min(y))', 6)} AS aspect_ratio,
  {rnd('(SELECT avg(v) FROM (SELECT var_pop(c) AS v FROM (SELECT cluster, unnest([x, y]) AS c FROM point) GROUP BY cluster))', 6)}
    AS within_cluster_variance FROM point"""
    ),
    "clusters_per_domain": with_base(
        "SELECT domain, domain_label, count(DISTINCT cluster) AS clusters, count(*) AS grants FROM point GROUP BY 1, 2"
    ),
    "level_centres": with_base(
        " UNION ALL ".join(
            f"""SELECT '{level}' AS level, {level} AS id, {label} AS label, {rnd('avg(x)', 4)} AS x, {rnd('avg(y)', 4)} AS y,
  count(*) AS count FROM point GROUP BY 2, 3"""
            for level, label in (
                ("domain", "domain_label"),
                ("topic", "domain_label || ' - Topic ' || topic"),
                ("subtopic", "domain_label || ' - Topic ' || topic || ' - Subtopic ' || subtopic"),
            )
        )
    ),
    "density_grid": with_base(
        f"""SELECT * FROM (SELECT domain, cell_x, cell_y, n, {rnd('n::DOUBLE / max(n) OVER (PARTITION BY domain)', 6)} AS intensity FROM (
  SELECT domain, least(49, floor((x - x0) * 50 / (x1 - x0)))::INTEGER AS cell_x,
    least(49, floor((y - y0) * 50 / (y1 - y0)))::INTEGER AS cell_y, count(*) AS n
  FROM point CROSS JOIN (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM point) GROUP BY 1, 2, 3))
WHERE intensity > 0.1"""
    ),
    "region_boxes": with_base(
        """SELECT domain, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, count(*) AS count
FROM point GROUP BY 1"""
    ),
    "zoom_points": with_base(
        "SELECT key, domain, x, y FROM (SELECT *, " + POINT_KEY + " AS key FROM point) ORDER BY md5(key), key LIMIT 7500"
    ),
    "background_points": with_base(
        "SELECT key, domain, x, y FROM (SELECT *, " + POINT_KEY + """ AS key FROM point)
WHERE ('0x' || substr(md5(key), 1, 8))::BIGINT % 10 = 0"""
    ),
    "neighborhood_cards": with_base(
        """SELECT center, count(*) AS grants, sum(cost)::DOUBLE AS total_funding FROM (
  SELECT c.cluster AS center, p.cost, row_number() OVER (PARTITION BY c.cluster ORDER BY p.key) AS r
  FROM (SELECT * FROM kp QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY key) = 1) c
  JOIN kp p ON abs(p.x - c.x) < 0.5 AND abs(p.y - c.y) < 0.5) WHERE r <= 5 GROUP BY 1""",
        kp="SELECT *, " + POINT_KEY + " AS key FROM point",
    ),
}

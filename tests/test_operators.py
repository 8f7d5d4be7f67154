"""Operators against brute force on small fixtures."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grantloom.functions import names, wording, years
from grantloom.functions.dimension import funding_units
from grantloom.operators import density, grouped_kmeans, neighbors, ranking
from grantloom.operators.facets import attached, top_values, yearly_distinct
from grantloom.plans import clustering, features, labels, maps, metrics, sampling, validation


def digest(value):
    return hashlib.md5(str(value).encode()).hexdigest()


def skewed(spark, rows=3000):
    """A third of all rows in one group."""
    return spark.range(rows).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g")
    )


def test_shuffled_rank_equals_window(spark):
    rows = [r.asDict() for r in ranking.shuffled_rank(skewed(spark), ["g"], "id").collect()]
    frame = pd.DataFrame(rows)
    frame["digest"] = frame["id"].map(digest)
    frame = frame.sort_values(["g", "digest"])
    assert (frame.groupby("g").cumcount() + 1 == frame["row_number"]).all()
    assert (frame.groupby("g")["id"].transform("size") == frame["group_total"]).all()


def test_shuffled_head_is_the_digest_order(spark):
    got = {r.id for r in ranking.shuffled_head(skewed(spark), "id", 100).collect()}
    assert got == set(sorted(range(3000), key=digest)[:100])


def test_missing_keys_are_ranked_too(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (4, None)], "id long, g string")
    assert sorted(r.row_number for r in ranking.shuffled_rank(rows, ["g"], "id").collect()) == [1, 1, 2, 3]
    assert ranking.quota_sample(rows, ["g"], "id", F.lit(10)).count() == 4
    assert ranking.shuffled_head(rows, "id", 4).count() == 4


def test_quota_sample_is_the_first_rows_of_each_group(spark):
    rows = skewed(spark)
    quota = F.ceil(F.col("group_total") * 0.1)
    got = {r.id for r in ranking.quota_sample(rows, ["g"], "id", quota).collect()}
    frame = pd.DataFrame([r.asDict() for r in rows.collect()])
    frame["digest"] = frame["id"].map(digest)
    want = set()
    for _, part in frame.sort_values("digest").groupby("g"):
        want |= set(part["id"].head(math.ceil(len(part) * 0.1)))
    assert got == want
    table = spark.createDataFrame([("hot", 7), ("g1", 2), ("none", 3)], "g string, quota int")
    found = ranking.quota_sample(rows, ["g"], "id", table).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in found} == {"hot": 7, "g1": 2}


def test_cut_is_independent_of_the_order_in_the_strata(spark):
    """Small strata keep the share that an independent draw leaves them."""
    rows = spark.range(22_000).select(
        F.col("id"), F.when(F.col("id") < 19_000, F.lit("big")).otherwise(F.concat(F.lit("s"), F.col("id") % 300)).alias("stratum")
    )
    kept = sampling.proportional(rows, "id", 200).groupBy((F.col("stratum") == "big").alias("big")).count().collect()
    shares = {r.big: r["count"] for r in kept}
    candidates = math.ceil(19_000 * 200 / 22_000), 300
    assert sum(shares.values()) == 200
    assert abs(shares[False] - 200 * candidates[1] / sum(candidates)) < 25


def test_grouped_median_is_the_lower_median(spark):
    random = np.random.RandomState(1)
    data = pd.DataFrame({"k": random.randint(0, 3, 500), "v": random.randint(0, 9000, 500).astype(float)})
    got = {r.k: r.m for r in validation.grouped_median(spark.createDataFrame(data), "k", "v", "m").collect()}
    for key, part in data.groupby("k"):
        assert got[key] == sorted(part["v"])[math.ceil(len(part) / 2) - 1]


def test_top_values_break_ties_by_value(spark):
    rows = spark.createDataFrame([("a", v) for v in "xxyyz"] + [("b", "q")], "k string, v string")
    got = {r.k: [(c["value"], c["count"]) for c in r.top] for r in top_values(rows, ["k"], {"top": ("v", 2)}).collect()}
    assert got == {"a": [("x", 2), ("y", 2)], "b": [("q", 1)]}


def test_yearly_distinct_equals_expansion(spark):
    random = np.random.RandomState(2)
    data = pd.DataFrame({"u": random.randint(0, 3, 200), "p": random.randint(0, 20, 200), "first": random.randint(1980, 2026, 200)})
    data["last"] = data["first"] + random.randint(0, 12, 200)
    rows = spark.createDataFrame(data)
    got = yearly_distinct(rows, ["u"], years.span_mask(F.col("first"), F.col("last")), {"people": "p"}).toPandas()
    wide = data.assign(y=[range(a, b + 1) for a, b in zip(data["first"], data["last"])]).explode("y")
    wide = wide[(wide.y >= 1985) & (wide.y <= 2024)].groupby(["u", "y"])["p"].nunique()
    assert dict(zip(zip(got.u, got.fiscal_year), got.people)) == wide.to_dict()


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_cosine_neighbors_are_exact(spark, block_rows):
    random = np.random.RandomState(3)
    q, r = random.randn(23, 5), random.randn(40, 5)
    r[7] = r[3]  # an exact copy: ties go to the smaller id
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, vector array<double>")
    refs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r)], "reference_id bigint, vector array<double>")
    got = neighbors.cosine_neighbors(queries, refs, 5, block_rows).collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(q) @ unit(r).T, 9)
    for i in range(len(q)):
        want = sorted(range(40), key=lambda j: (-scores[i, j], j))[:5]
        assert [x.reference_id for x in sorted((x for x in got if x.query_id == i), key=lambda x: x.place)] == want


def test_box_neighbors_are_exact(spark):
    random = np.random.RandomState(4)
    xy = random.uniform(-3, 3, (300, 2))
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "pid int, x double, y double")
    centers = points.where("pid < 10").withColumnRenamed("pid", "cid")
    got = {(r.cid, r.pid) for r in neighbors.box_neighbors(centers, points, "cid", "pid", 0.5, None).collect()}
    want = {(c, p) for c in range(10) for p in range(300) if (np.abs(xy[c] - xy[p]) < 0.5).all()}
    assert got == want


def brute_density(xy, eps, min_samples):
    """Plain density clustering: core flags and core components."""
    gaps = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    near = gaps <= eps
    core = near.sum(1) >= min_samples
    label = np.full(len(xy), -1)
    for start in np.flatnonzero(core):
        if label[start] >= 0:
            continue
        stack = [start]
        label[start] = start
        while stack:
            for other in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                label[other] = start
                stack.append(other)
    reachable = near[:, core].any(1)
    return core, label, reachable


@pytest.mark.parametrize("seed,eps,min_samples", [(5, 0.25, 5), (6, 0.4, 12), (7, 0.15, 4)])
def test_density_clusters_equal_brute_force(spark, seed, eps, min_samples):
    random = np.random.RandomState(seed)
    blobs = [random.randn(80, 2) * 0.3 + c for c in ((0, 0), (2, 0), (2.5, 2))]
    line = np.column_stack([np.linspace(-3, -1, 60), np.full(60, 3.0)])
    copies = np.tile([[5.0, 5.0]], (40, 1))
    xy = np.vstack([*blobs, line, copies, random.uniform(-4, 6, (60, 2))])
    rows = [(i, 0, float(a), float(b)) for i, (a, b) in enumerate(xy)]
    points = spark.createDataFrame(rows, "id int, group int, x double, y double")
    got = density.density_clusters(points, eps, min_samples).toPandas().sort_values("id")["cluster"].to_numpy()
    core, label, reachable = brute_density(xy, eps, min_samples)
    assert [g is not None and g == g for g in got] == list(reachable)
    pairs = {(a, b) for a, b, c in zip(label, got, core) if c}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_noise_goes_to_the_nearest_mean(spark):
    rows = [(0, 0.0, 1, "a"), (0, 4.0, 1, "b"), (0, 1.0, 9, "b"), (0, 0.6, 1, None), (0, 0.4, 1, None), (1, 9.0, 1, None)]
    frame = spark.createDataFrame(rows, "group int, x double, n int, cluster string").withColumn("y", F.lit(0.0))
    got = {(r.group, r.x): (r.cluster, r.was_noise) for r in density.noise_to_nearest(frame).collect()}
    assert got[0, 0.6] == ("a", True) and got[0, 0.4] == ("a", True)
    assert got[0, 1.0] == ("b", False) and got[1, 9.0] == (None, True)


def test_grouped_kmeans_finds_separate_blobs(spark):
    random = np.random.RandomState(8)
    rows = []
    for group in range(3):
        for centre in range(2 + group):
            for _ in range(50):
                rows.append((len(rows), group, 2 + group, (random.randn(3) * 0.05 + centre * 10 + group).tolist(), centre))
    frame = spark.createDataFrame(rows, "id bigint, group int, k int, vector array<double>, truth int")
    centres = grouped_kmeans.fit(frame, 4)
    got = grouped_kmeans.assign(frame.drop("k"), centres).select("group", "truth", "centre").distinct().collect()
    assert len(got) == 2 + 3 + 4


def test_repeated_places_do_not_lose_centres(spark):
    """Centres are lowered only where a group has fewer distinct vectors."""
    rows = spark.range(20_000).select(
        "id", F.lit(0).alias("group"), F.lit(6).alias("k"),
        F.array(F.when(F.col("id") < 19_900, 0.0).otherwise((F.col("id") % 50 + 1.0) * 10.0), F.lit(0.0)).alias("vector"),
    ).unionByName(spark.range(30).select("id", F.lit(1).alias("group"), F.lit(6).alias("k"), F.array(F.col("id") % 3 * 1.0, F.lit(1.0)).alias("vector")))
    centres = grouped_kmeans.fit(rows.persist(), 6, starts=2)
    assert len(centres[0]) == 6 and len(centres[1]) == 3


def test_groups_with_missing_keys_keep_their_figures(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    more = spark.createDataFrame([(None, 5), ("a", 6)], "k string, w int")
    assert {tuple(r) for r in attached(left, more, ["k"]).collect()} == {(None, 1, 5), ("a", 2, 6)}


def test_labels_keep_groups_without_words(spark):
    kind = "cluster int, application_id string, terms string, title string, categories string, domain int, topic int, subtopic int"
    points = spark.createDataFrame([(1, "a", None, "in the of", None, 1, 1, 1), (2, "b", "alpha beta; gamma", "Alpha study", "Cat", 2, 2, 2)], kind)
    assert {r.cluster: r.label for r in labels.term_labels(points).collect()}[1] == "Topic 1"
    assert {r.cluster: r.label for r in labels.title_labels(points).collect()}[1] == "Cluster 1"
    assert {r.topic: r.topic_label for r in labels.hierarchy_labels(points).collect()}[1] == "General Research > Topic 1"


@pytest.mark.parametrize("rules", ["by_vector", "by_vector_large", "by_coordinates"])
def test_hierarchy_is_a_tree_and_total(spark, rules):
    random = np.random.RandomState(9)
    data = [(i, random.randn(4).tolist()) for i in range(600)]
    got = clustering.three_levels(spark.createDataFrame(data, "id bigint, vector array<double>"), 3, rules).toPandas()
    assert sorted(got["id"]) == list(range(600))
    assert got.groupby("topic")["domain"].nunique().max() == 1
    assert got.groupby("subtopic")["topic"].nunique().max() == 1
    assert sorted(got["topic"].unique()) == list(range(got["topic"].nunique()))


def test_per_unit_leaves_small_units_out(spark):
    random = np.random.RandomState(10)
    data = [(i, "big" if i < 120 else "small", random.randn(3).tolist()) for i in range(150)]
    got = clustering.per_unit(spark.createDataFrame(data, "id bigint, unit string, vector array<double>"), "unit").toPandas()
    assert set(got["unit"]) == {"big"} and len(got) == 120 and got["centre"].nunique() <= 5


def test_region_outline_is_the_hull(spark):
    random = np.random.RandomState(11)
    xy = random.randn(500, 2)
    frame = spark.createDataFrame([(0, float(a), float(b)) for a, b in xy], "domain int, x double, y double").repartition(7)
    got = maps.region_outlines(frame).toPandas()[["x", "y"]].to_numpy()
    for i in range(len(got)):
        a, b = got[i], got[(i + 1) % len(got)]
        side = (b[0] - a[0]) * (xy[:, 1] - a[1]) - (b[1] - a[1]) * (xy[:, 0] - a[0])
        assert (side >= -1e-9).all()


def test_separation_equals_definitions(spark):
    random = np.random.RandomState(12)
    x, y = random.randn(90, 3), np.arange(90) % 4
    frame = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y)], "v array<double>, c int")
    got = metrics.separation(frame, "v", "c").first()
    centres = np.array([x[y == c].mean(0) for c in range(4)])
    scatter = np.array([np.linalg.norm(x[y == c] - centres[c], axis=1).mean() for c in range(4)])
    within = sum(((x[y == c] - centres[c]) ** 2).sum() for c in range(4))
    between = sum((y == c).sum() * ((centres[c] - x.mean(0)) ** 2).sum() for c in range(4))
    worst = [max((scatter[i] + scatter[j]) / np.linalg.norm(centres[i] - centres[j]) for j in range(4) if j != i) for i in range(4)]
    assert got.calinski_harabasz == pytest.approx(between / 3 / (within / 86), abs=1e-5)
    assert got.davies_bouldin == pytest.approx(np.mean(worst), abs=1e-5)


def test_identical_labelings_agree_fully(spark):
    frame = spark.range(60).select((F.col("id") % 4).alias("a"), (F.col("id") % 4 + 10).alias("b"))
    assert metrics.adjusted_rand(frame, "a", "b").first()[0] == 1.0


def test_quota_sample_meets_its_size(spark):
    rows = spark.range(20000).select(
        F.col("id").alias("key"), (F.lit(2000) + F.col("id") % 7).cast("double").alias("FY"),
        F.when(F.col("id") % 3 == 0, "A").otherwise(F.concat(F.lit("U"), F.col("id") % 11)).alias("IC_NAME"),
        F.lit("t").alias("PROJECT_TITLE"),
    )
    assert sampling.year_unit_quota(rows, "key", 1000).count() == 1000


def test_hybrid_blocks_are_scaled(spark):
    rows = spark.createDataFrame(
        [(i, [float(i), float(i * i % 7)], ["a", "b"] if i % 2 else ["c"], "u" if i % 3 else None) for i in range(30)],
        "id int, e array<double>, cats array<string>, unit string",
    )
    rows = features.scaled_embedding(rows, "e", "semantic")
    rows = features.unit_vectors(features.category_vectors(rows, F.col("cats"), "categories"), "unit", "codes")
    shaped = features.hybrid(rows, {"semantic": 0.7, "categories": 0.2, "codes": 0.1}, "semantic")
    vector = shaped.first().features.toArray()
    assert len(vector) == 2 + 3 + 2
    assert max(vector[2:5]) == pytest.approx(0.2 * math.sqrt(2 / 3))


def test_text_vectors_have_unit_length(spark):
    rows = spark.createDataFrame([(i, f"red ring gear number {'blue' if i % 3 else 'green'}") for i in range(10)], "id int, t string")
    shaped = features.text_vectors(rows, "t", 2, 100, 2.0, 0.8)
    vectors = np.array([r.tfidf.toArray() for r in shaped.collect()])
    assert np.allclose(np.linalg.norm(vectors, axis=1), 1)
    reduced = features.reduced(shaped, "tfidf", 2, "small").collect()
    u, s, vt = np.linalg.svd(vectors, full_matrices=False)
    assert np.allclose(np.abs([r.small[0] for r in reduced]), np.abs(vectors @ vt[0]))


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


def test_name_fields(spark):
    raw = F.lit("DOE,  JANE (contact) | ROE, RICHARD")
    assert one(spark, names.first_person(names.without_contact_mark(raw))) == "DOE, JANE"
    assert one(spark, names.first_person(F.lit(None).cast("string"))) is None
    assert one(spark, names.entries(F.lit("a; b;;c "))) == ["a", "b", "c"]
    assert one(spark, names.funding_split(F.lit("CA:100\\HL:25.5\\"))) == {"CA": 100.0, "HL": 25.5}


@pytest.mark.parametrize(
    "word,single",
    [("cells", "cell"), ("proteins", "protein"), ("studies", "study"), ("mice", "mouse"), ("classes", "class"),
     ("boxes", "box"), ("virus", "virus"), ("analysis", "analysis"), ("gas", "gas"), ("ring", "ring")],
)
def test_lemmas(spark, word, single):
    assert one(spark, wording.lemma(F.lit(word))) == single


def test_term_cleaning_drops_stop_and_short_terms(spark):
    assert one(spark, wording.cleaned_terms(F.lit("Cell; DNA; Gene Expression; research; Mouse"))) == "gene expression mouse"


def test_ngrams(spark):
    grams = one(spark, wording.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 3))
    assert grams == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, wording.ngrams(F.array(F.lit("a")), 3)) == ["a"]


def test_dimension_has_45_units(spark):
    units = funding_units(spark).toPandas()
    assert len(units) == 45 and units["ic_code"].is_unique and list(units["sort_order"]) == list(range(1, 46))

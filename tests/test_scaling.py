"""Steps that were rewritten to scale: the same results, with fewer reads, rounds or bytes."""

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from grantloom.operators import blocks, minibatch, neighbors, sparse_kmeans, stacked_kmeans, truncated_svd
from grantloom.plans import assignment, clustering, features, investigator, labels, registry, slices, trends


def counted(spark, rows):
    """The rows, and a counter of how many of them have been read."""
    read = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    return rows.mapInPandas(run, rows.schema), read


def test_hierarchy_labels_read_the_points_once(spark):
    cells = [(i % 2, i % 4, i % 8, "Aging; Cancer" if i % 3 else None) for i in range(400)]
    points, read = counted(spark, spark.createDataFrame(cells, "domain int, topic int, subtopic int, categories string"))
    found = {r["subtopic"]: r for r in labels.hierarchy_labels(points).collect()}
    assert read.value == 400
    assert sorted(found) == list(range(8))
    assert found[5]["domain_label"] == "Aging & Cancer" and found[5]["topic_label"] == "Aging & Cancer > Aging"


def plain_sums(matrix, centres):
    gaps = ((matrix[:, None, :] - centres[None]) ** 2).sum(axis=2)
    best = gaps.argmin(axis=1)
    counts = np.bincount(best, minlength=len(centres))
    sums = np.array([matrix[best == c].sum(axis=0) for c in range(len(centres))])
    return counts, np.bincount(best, weights=gaps.min(axis=1), minlength=len(centres)), sums


def test_blocks_add_up_what_comparing_every_row_does(spark):
    random = np.random.RandomState(3)
    rows = [(i % 2, random.uniform(0, 50, 2).tolist()) for i in range(9000)]
    held = blocks.packed(spark.createDataFrame(rows, "group int, vector array<double>").repartition(3))
    centres = {0: random.uniform(0, 50, (12, 2)), 1: random.uniform(0, 50, (1, 2))}
    found = blocks.step(held, centres)
    held.unpersist()
    for group, own in centres.items():
        for got, right in zip(found[group], plain_sums(np.array([v for g, v in rows if g == group]), own), strict=True):
            assert np.allclose(got, right)
    wide = np.round(random.normal(size=(700, 64)), 6)
    block = blocks.Block(wide)
    counts, costs, sums = np.zeros(9), np.zeros(9), np.zeros((9, 64))
    block.add(wide[:9], counts, costs, sums)
    assert all(np.allclose(a, b) for a, b in zip((counts, costs, sums), plain_sums(wide, wide[:9]), strict=True))


def test_k_means_has_the_centres_of_mllib_without_its_rounds(spark, monkeypatch):
    random = np.random.RandomState(5)
    rows = [(i, (random.normal(size=2) + 6 * (i % 4)).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "id int, v array<double>").withColumn("features", array_to_vector("v")).repartition(2).persist()
    right = KMeans(k=4, seed=clustering.SEED, maxIter=300, featuresCol="features").fit(frame).transform(frame)
    wanted = {r["id"]: r["prediction"] for r in right.collect()}
    rounds = []
    monkeypatch.setattr(clustering, "KMeans", lambda **given: rounds.append(given["maxIter"]) or KMeans(**given))
    assert {r["id"]: r["cluster"] for r in clustering.k_means(frame, "features", 4).collect()} == wanted
    assert rounds == [0]


def test_small_batches_are_read_in_windows(spark, monkeypatch):
    random = np.random.RandomState(7)
    frame = spark.createDataFrame([(i, random.normal(size=3).tolist()) for i in range(900)], "id int, vector array<double>")
    passes = []
    step, window = minibatch._step, minibatch._window
    monkeypatch.setattr(minibatch, "_step", lambda *a: passes.append("batch") or step(*a))
    monkeypatch.setattr(minibatch, "_window", lambda *a: passes.append("window") or window(*a))
    together, read = minibatch.fit(frame, 6, 100)
    assert passes == ["window"] and len(read) == 9 and sum(read) == 900
    monkeypatch.setattr(minibatch, "WINDOW_ROWS", 1)
    single, again = minibatch.fit(frame, 6, 100)
    assert passes[1:] == ["batch"] * 9 and again == read and np.allclose(together, single)


def test_a_query_travels_once_for_each_shelf(spark, monkeypatch):
    """Small cells share a shelf, and no task gets a block for every few rows of them."""
    random = np.random.RandomState(11)
    vectors = random.normal(size=(600, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "query_id long, vector array<double>")
    sent = []
    best = neighbors._best_in_shelves
    monkeypatch.setattr(neighbors, "_best_in_shelves", lambda visits, *rest: sent.append(visits.count()) or best(visits, *rest))
    report = []
    found = neighbors.cosine_neighbors(frame, frame.withColumnRenamed("query_id", "reference_id"), 3, 16, report).collect()
    assert all(n <= 600 for n in sent) and sum(cells for _, cells in report) > 5 * sum(sent)
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(units @ units.T, neighbors.SIMILARITY_DIGITS)
    wanted = {(i, int(j)) for i in range(600) for j in np.lexsort((np.arange(600), -scores[i]))[:3]}
    assert {(r["query_id"], r["reference_id"]) for r in found} == wanted


def test_block_best_breaks_ties_by_id_within_a_floor():
    queries = pd.DataFrame({"query_id": [1, 2], "vector": [np.array([1.0, 0.0]), np.array([0.0, 1.0])], "floor": [-2.0, 0.9]})
    references = pd.DataFrame({"reference_id": [9, 3, 5, 7], "vector": [np.array([1.0, 0.0])] * 3 + [np.array([0.0, 2.0])]})
    found = neighbors.block_best(queries, references, 2)
    assert list(zip(found["query_id"], found["reference_id"])) == [(1, 3), (1, 5), (2, 7)]


def test_a_bitmap_of_awards_is_a_number(spark):
    """Thin groups cost a few bytes, not a bitmap of 4 KB each."""
    points = spark.createDataFrame([("A", 2000, 1, a) for a in (0, 63, 64, 64, 10**12)], "ic string, fy int, domain int, award long")
    held = slices.award_bitmaps(points, "award")
    assert held.schema["awards"].dataType.simpleString() == "bigint"
    assert held.count() == 3 and slices.distinct_awards(held, slices.Slice(), "ic").first()["awards"] == 4


def test_stacked_fits_use_all_cores(spark, monkeypatch):
    """A table in one partition is dealt out before the passes."""
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(210)], "id int, vector array<double>").coalesce(1)
    parts, moments = [], stacked_kmeans.moments
    monkeypatch.setattr(stacked_kmeans, "moments", lambda held: parts.append(held.rdd.getNumPartitions()) or moments(held))
    found = stacked_kmeans.search(rows, [stacked_kmeans.Candidate((21,), 21, np.ones(2))], False)
    assert parts == [spark.sparkContext.defaultParallelism]
    assert found[0]["clusters"] == 21 and found[0]["low"] == found[0]["high"] == 10 and abs(found[0]["cost"]) < 1e-9


def test_texts_are_cut_into_runs_twice(spark):
    """Once for the vocabulary and once for the counts, whatever reads the weights afterwards."""
    texts, read = counted(spark, spark.createDataFrame([(i, f"alpha beta word{i % 5}") for i in range(60)], "id int, text string"))
    shaped = features.text_vectors(texts, "text")
    for _ in range(2):
        assert shaped.where("id >= 0").select("id", "tfidf").toPandas().shape == (60, 2)
    assert read.value <= 180  # the vocabulary reads once to count and once to collect


def test_broader_impact_does_not_store_all_awards(spark, root, monkeypatch):
    """The same cards as from the stored base, without building it."""
    wanted = investigator.broader_impact(registry.clustered(spark, root)).collect()
    monkeypatch.setattr(registry.source, "awards", None)
    monkeypatch.setattr(registry.source, "clustered_awards", None)
    assert sorted(registry.pi_broader_impact(spark, root).collect(), key=str) == sorted(wanted, key=str)


def test_trends_do_not_store_all_awards(spark, root, monkeypatch):
    wanted = trends.recent(trends.portfolio_trends(trends.funded_years(registry.source.awards(spark, root)))).collect()
    monkeypatch.setattr(registry.source, "awards", None)
    assert registry.temporal_trends_recent(spark, root).collect() == wanted


def test_merged_cards_store_the_columns_they_read(spark, root, monkeypatch):
    """The same cards as from the base with all facets, which is not built."""
    awards = registry.all_awards(spark, root)
    wanted = assignment.merged_cards(awards, assignment.by_unit_heuristic(awards), "existing", "IC-heuristic").select(*registry.MERGED_COLUMNS)
    wanted = sorted(wanted.collect(), key=str)
    written, folder = [], registry.source.scratch_folder
    monkeypatch.setattr(registry.source, "_stored", {})
    monkeypatch.setattr(registry.source, "scratch_folder", lambda *args: written.append(folder(*args)) or written[-1])
    assert sorted(registry.merged_cards_existing_first(spark, root).collect(), key=str) == wanted
    assert [len(spark.read.parquet(path).columns) for path in written] == [8]
    registry.merged_cards_assigned_first(spark, root)
    assert len(written) == 1  # read again
    registry.all_awards(spark, root)
    assert len(written) == 2
    registry.portfolio_cluster_summary(spark, root)
    assert len(written) == 2  # the whole base has what it needs


def test_unit_topics_clean_the_terms_once(spark):
    """However many steps and rounds follow, and for the cards too."""
    cells = [(f"P{i}", "AB"[i % 2], f"alpha; word{i % 6}; word{i % 7}; beta{i % 5}") for i in range(240)]
    rows, read = counted(spark, spark.createDataFrame(cells, "id string, unit string, terms string"))
    words = clustering.unit_words(rows, "unit", "terms")
    topics = clustering.term_topics(words, "unit")
    cards = clustering.term_topic_cards(topics, words, "unit").collect()
    assert read.value == 240
    assert sum(r["size"] for r in cards) == topics.count() == 240 and {r["unit"] for r in cards} == {"A", "B"}


def test_blocks_of_sparse_rows_hold_every_cell(spark, monkeypatch):
    cells = [(i, i % 3, [j for j in range(i % 5)], [j + i / 8 for j in range(i % 5)]) for i in range(97)]
    rows = spark.createDataFrame(cells, "id int, group int, __at array<int>, __by array<double>").repartition(2)
    for most in (1, 50, 2_000_000):
        monkeypatch.setattr(sparse_kmeans, "HELD_CELLS", most)
        found = []
        for group, sizes, at, by in sparse_kmeans.packed(rows).collect():
            sizes, at, by = np.frombuffer(sizes, "<i4"), np.frombuffer(at, "<i4"), np.frombuffer(by, "<f8")
            for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
                found.append((group, at[end - size : end].tolist(), by[end - size : end].tolist()))
        assert sorted(found) == sorted((g, a, b) for _, g, a, b in cells)
    for most in (1, 7, 1000):
        monkeypatch.setattr(sparse_kmeans, "STEP_CELLS", most)
        sizes = np.array([0, 3, 0, 5, 1, 0])
        steps = list(sparse_kmeans._steps(sizes))
        assert [s[0] for s in steps] == [0, *(s[1] for s in steps)][:-1] and steps[-1][1::2] == (6, 9)
        assert all(sizes[a:b].sum() == d - c and sizes[:a].sum() == c for a, b, c, d in steps)


def test_a_pass_of_the_decomposition_gets_no_objects_per_row(spark, monkeypatch):
    """The product over flat arrays is that of the whole matrix, also for rows without cells and repeated positions."""
    random = np.random.RandomState(13)
    matrix, rows = np.zeros((700, 40)), []
    for i in range(700):
        at, by = random.randint(0, 40, i % 7).tolist(), random.normal(size=i % 7).tolist()
        np.add.at(matrix[i], at, by)
        rows.append((at, by))
    sparse = spark.createDataFrame(rows, "__at array<int>, __by array<double>").repartition(3)
    monkeypatch.setattr(truncated_svd, "times", None)
    block = random.normal(size=(40, 5))
    assert np.allclose(truncated_svd._pass(sparse, block), matrix.T @ matrix @ block)


def test_text_projection_does_not_store_all_awards(spark, root, monkeypatch):
    monkeypatch.setattr(registry.source, "awards", None)
    found = registry.text_projection_facts(spark, root).first()
    assert found["rows"] == spark.read.parquet(f"{root}/orders.parquet").count() and found["mean_x"] == found["mean_y"] == 0

"""Hierarchies, pruned neighbours and density clusters against brute force, and under skew."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from grantloom.operators import density, minibatch, neighbors, sparse_kmeans, stacked_kmeans, truncated_svd, ward
from grantloom.operators.components import components
from grantloom.plans import slices
from grantloom.streaming import incremental


def brute_ward(points):
    """Heights of all merges, and the groups after each, by a search over all pairs."""
    groups = [[i] for i in range(len(points))]
    out = []
    while len(groups) > 1:
        best = None
        for i in range(len(groups)):
            for j in range(i):
                a, b = points[groups[i]], points[groups[j]]
                gap = 2 * len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()
                if best is None or gap < best[0]:
                    best = (gap, j, i)
        gap, j, i = best
        groups[j] = groups[j] + groups.pop(i)
        out.append((math.sqrt(gap), {frozenset(g) for g in groups}))
    return out


def test_ward_equals_brute_force(spark):
    random = np.random.RandomState(1)
    points = np.vstack([random.randn(12, 3) * s + c for s, c in ((0.3, 0), (1.0, 4), (0.1, 9))])
    points = np.vstack([points, points[:5]])  # copies merge at height zero
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(99, None)], "id long, vector array<double>")
    tree = ward.hierarchy(frame)
    expected = brute_ward(points)
    assert np.allclose(tree.merges["height"], [h for h, _ in expected][5:])
    assert [r["size"] for r in ward.merge_table(frame, tree).orderBy("place").collect()][-1] == len(points)
    for k in (1, 2, 3, 7, 20):
        rows = {r["id"]: r["cluster"] for r in ward.assigned(frame, tree, k).collect()}
        assert rows.pop(99) is None
        got = {}
        for i, label in rows.items():
            got.setdefault(label, set()).add(i)
        assert {frozenset(g) for g in got.values()} == expected[len(points) - 1 - k][1]
        assert sorted(got) == list(range(k))


def test_ward_of_more_vectors_than_leaves(spark):
    """Rounds of bounded buckets end at the bound, keep all rows, and separate what lies apart."""
    random = np.random.RandomState(2)
    blob = random.randint(0, 5, 3000)
    points = random.randn(3000, 2) * 0.2 + np.column_stack([blob * 5.0, blob % 2 * 9.0])
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>").repartition(5)
    found = ward.features(frame.select("vector"), 50).collect()
    assert 5 < len(found) <= 50 and sum(r["n"] for r in found) == 3000
    assert np.allclose(sum(np.array(r["vector"]) * r["n"] for r in found) / 3000, points.mean(0))
    labels = {r["id"]: r["cluster"] for r in ward.assigned(frame, ward.hierarchy(frame.select("vector"), 50), 5).collect()}
    assert len({(blob[i], label) for i, label in labels.items()}) == 5 == len(set(labels.values()))
    empty = frame.limit(0)
    assert ward.assigned(frame, ward.hierarchy(empty.select("vector")), 3).where("cluster is not null").count() == 0


def brute_neighbors(queries, references, k):
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    scores = np.round(unit(queries) @ unit(references).T, neighbors.SIMILARITY_DIGITS)
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return {(i, p + 1): (int(j), scores[i, j]) for i, row in enumerate(best) for p, j in enumerate(row)}


@pytest.mark.parametrize("k, block_rows", [(3, 20), (7, 64), (400, 30)])
def test_pruned_neighbors_are_exact(spark, k, block_rows):
    random = np.random.RandomState(3)
    centres = random.randn(15, 6)
    references = centres[random.randint(0, 15, 600)] + random.randn(600, 6) * 0.1
    references[:200] = references[7]  # a third are copies
    references[300:305] = 0.0
    queries = np.vstack([centres[random.randint(0, 15, 60)] + random.randn(60, 6) * 0.2, np.zeros((2, 6)), -centres[:3]])
    frames = [
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} long, vector array<double>")
        for name, m in (("query_id", queries), ("reference_id", references))
    ]
    got = {(r.query_id, r.place): (r.reference_id, r.similarity) for r in neighbors.cosine_neighbors(*frames, k, block_rows).collect()}
    want = brute_neighbors(queries, references, k)
    assert got.keys() == want.keys()
    for key, (reference, similarity) in want.items():
        assert got[key][1] == pytest.approx(similarity, abs=2e-9)
    same = sum(got[key][0] == want[key][0] for key in want)
    assert same >= 0.99 * len(want)  # scores that differ in the last digit only may change places
    empty = [f.limit(0) for f in frames]
    assert neighbors.cosine_neighbors(empty[0], frames[1], k).count() == 0 == neighbors.cosine_neighbors(frames[0], empty[1], k).count()


def test_visited_cells_grow_slower_than_their_pairs(spark):
    random = np.random.RandomState(4)
    shares = []
    for size in (1000, 4000):
        centres = random.randn(size // 40, 12)
        rows = [(i, (centres[i % len(centres)] + random.randn(12) * 0.05).tolist()) for i in range(size)]
        frame = spark.createDataFrame(rows, "query_id long, vector array<double>")
        report = []
        found = neighbors.cosine_neighbors(frame, frame.withColumnRenamed("query_id", "reference_id"), 5, 40, report)
        assert found.count() == 5 * size
        shares.append((report[0][0], sum(v for _, v in report) / size))
    (cells, visits), (more_cells, more_visits) = shares
    assert more_cells > 3 * cells and more_visits < 2 * visits and more_visits < 0.1 * more_cells


def brute_density(xy, eps, min_samples):
    gaps = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    near = gaps <= eps
    core = near.sum(1) >= min_samples
    label = np.full(len(xy), -1)
    for start in np.flatnonzero(core):
        if label[start] < 0:
            stack = [start]
            label[start] = start
            while stack:
                for other in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                    label[other] = start
                    stack.append(other)
    return core, label, near[:, core].any(1)


@pytest.mark.parametrize("direct", [2])
def test_split_cells_give_the_same_clusters(spark, monkeypatch, direct):
    """Cells of more than a place or three are answered by their parts, down to single places."""
    monkeypatch.setattr(density, "DIRECT", direct)
    random = np.random.RandomState(5)
    blobs = [random.randn(90, 2) * 0.15 + c for c in ((0, 0), (1.2, 0), (1.5, 1.4))]
    xy = np.vstack([*blobs, np.column_stack([np.linspace(-3, -1, 50), np.full(50, 2.0)]), random.uniform(-3, 3, (50, 2))])
    points = spark.createDataFrame([(i, 0, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id int, group int, x double, y double")
    for eps, least in ((0.3, 6),):
        got = density.density_clusters(points, eps, least).toPandas().sort_values("id")["cluster"].to_numpy()
        core, label, reachable = brute_density(xy, eps, least)
        assert [g is not None and g == g for g in got] == list(reachable)
        pairs = {(a, b) for a, b, c in zip(label, got, core) if c}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_a_cell_of_a_million_places(spark):
    """Distinct places, not copies, in one cell and its neighbour; thin places around are counted exactly."""
    eps, side = 1.0, 1.0 / math.sqrt(2)
    random = np.random.RandomState(6)
    thin = np.column_stack([random.uniform(-1.4, 1.9, 120), random.uniform(-1.4, 1.9, 120)])
    thin = thin[(thin[:, 0] < -0.02) | (thin[:, 0] > side + 0.02) | (thin[:, 1] < -0.02) | (thin[:, 1] > side + 0.02)]
    crowd = spark.range(1_000_000, numPartitions=8).select(
        F.lit(0).alias("group"), (F.rand(1) * side * 0.999).alias("x"), (F.rand(2) * side * 0.999).alias("y")
    )
    far = spark.createDataFrame([(0, float(a), float(b)) for a, b in thin], "group int, x double, y double")
    points = crowd.unionByName(far).unionByName(spark.createDataFrame([(1, 50.0, 50.0)], "group int, x double, y double"))
    places = density.density_places(points, eps, 1000)
    held = np.array(crowd.select("x", "y").collect())
    gaps = [np.sqrt(((held - p) ** 2).sum(1)) for p in thin]
    own = np.sqrt(((thin[:, None] - thin[None]) ** 2).sum(-1)) <= eps
    core = np.array([(g <= eps).sum() for g in gaps]) + own.sum(1) >= 1000
    reached = [g.min() <= eps or own[i, core].any() for i, g in enumerate(gaps)]
    found = {(r.x, r.y): r.cluster for r in places.where(~((F.col("x") >= 0) & (F.col("x") <= side) & (F.col("y") >= 0) & (F.col("y") <= side))).collect()}
    assert [found[tuple(p)] is not None for p in thin] == reached
    assert 0 < sum(core) < sum(reached)
    assert found[50.0, 50.0] is None
    assert places.where("cluster is not null").select("cluster").distinct().count() == 1


def test_two_crowded_cells_just_in_or_out_of_reach(spark):
    """The gap of two crowds is decided by few of their places, though no box or sample of them decides it at once."""
    eps, side = 1.0, 1.0 / math.sqrt(2)
    for gap, clusters in ((0.9999, 1), (1.0001, 2)):
        left = spark.range(30_000).select(F.lit(0).alias("group"), (-F.rand(1) * side * 0.5 - 0.001).alias("x"), (F.rand(2) * 0.7).alias("y"))
        right = spark.range(30_000).select(F.lit(0).alias("group"), (F.rand(3) * 0.2 + gap + 0.01).alias("x"), (F.rand(4) * 0.7).alias("y"))
        ends = spark.createDataFrame([(0, 0.0 - 0.0005, 0.35), (0, gap - 0.0005, 0.35)], "group int, x double, y double")
        places = density.density_places(left.unionByName(right).unionByName(ends), eps, 500)
        assert places.select("cluster").distinct().count() == clusters


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 164)] + [(5, 5), (7, 9), (9, 7), (7, 9), (None, 3)] + [(1000, 1000 + i) for i in range(1, 300)]
    frame = spark.createDataFrame(edges, "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(100, 165), 5, 7, 9, 50, *range(1000, 1300)]], "node long")
    found = {r.node: r.label for r in components(nodes, frame).collect()}
    want = {i: 100 for i in range(100, 165)} | {5: 5, 50: 50, 7: 7, 9: 7} | {i: 1000 for i in range(1000, 1300)}
    assert found == want


def test_topics_are_numbered_over_many_ranges(spark):
    names = [(g, f"{c:03d}", float(c), 0.0) for g in range(5) for c in range(70)]
    rows = spark.createDataFrame(names + [(2, None, 1.0, 1.0)], "group int, cluster string, x double, y double").repartition(6)
    found = density.numbered(rows).collect()
    order = {key: i for i, key in enumerate(sorted((g, c) for g, c, _, _ in names))}
    assert {(r.group, r.cluster): r.topic for r in found} == order | {(2, None): None}


def test_noise_meets_the_nearest_of_many_means(spark):
    random = np.random.RandomState(7)
    means = random.uniform(-5, 5, (300, 2))
    rows = [(0, float(x), float(y), 2, f"c{i:03d}") for i, (x, y) in enumerate(means)]
    noise = random.uniform(-9, 9, (200, 2))
    rows += [(0, float(x), float(y), 1, None) for x, y in noise] + [(1, 3.0, 3.0, 1, None)]
    frame = spark.createDataFrame(rows, "group int, x double, y double, n int, cluster string")
    found = {(r.x, r.y): r.cluster for r in density.noise_to_nearest(frame).where("was_noise").collect()}
    assert found.pop((3.0, 3.0)) is None
    for p in noise:
        assert found[tuple(p)] == f"c{((means - p) ** 2).sum(1).argmin():03d}"


def lloyd(points, k, order, rounds):
    """Plain rounds from the first distinct points in the given order."""
    seen = list(dict.fromkeys(tuple(points[i]) for i in order))
    centres = np.array(seen[:k])
    for _ in range(rounds):
        near = ((points[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.array([points[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
    return centres, ((points[:, None] - centres[None]) ** 2).sum(-1).argmin(1)


def digest_order(n):
    return sorted(range(n), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())


def test_stacked_fits_equal_single_ones(spark):
    random = np.random.RandomState(8)
    points = np.vstack([random.randn(60, 4) + c for c in (0, 3, 7)])
    points[100:120] = points[100]
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>").repartition(4).persist()
    mean, deviation, n = stacked_kmeans.moments(frame)
    assert n == 180 and np.allclose(mean, points.mean(0)) and np.allclose(deviation, points.std(0))
    scaled = (points - mean) / deviation
    scales = [np.ones(4), np.array([1.0, 0.5, 0.0, 2.0])]
    candidates = [stacked_kmeans.Candidate((k, i), k, scale) for k in (2, 3, 9) for i, scale in enumerate(scales)]
    passes = stacked_kmeans.fit(frame, candidates, mean, deviation, 20)
    alone = [stacked_kmeans.fit(frame, [stacked_kmeans.Candidate(c.name, c.k, c.scale)], mean, deviation, 20) for c in candidates]
    assert passes == max(alone)  # the passes of the slowest fit, not of all
    for c, score in zip(candidates, stacked_kmeans.scores(frame, candidates, mean, deviation, plain=2), strict=True):
        own = scaled * c.scale
        centres, near = lloyd(own, c.k, digest_order(180), 20)
        assert np.allclose(c.centres, centres)
        gaps = ((own[:, None] - own[None]) ** 2).sum(-1)
        widths = []
        for i in range(180):
            to = {g: gaps[i, near == g].sum() / max((near == g).sum() - (g == near[i]), 1) for g in set(near)}
            a, b = to[near[i]], min(v for g, v in to.items() if g != near[i])
            widths.append((b - a) / max(a, b) if (near == near[i]).sum() > 1 else 0.0)
        assert score["silhouette"] == pytest.approx(np.mean(widths))
        assert (score["low"], score["high"]) == (np.bincount(near).min(), np.bincount(near).max())
        assert score["cost"] == pytest.approx(sum(((own[near == g] - own[near == g].mean(0)) ** 2).sum() for g in set(near)))


def test_mini_batches_read_each_row_once_and_come_close(spark):
    random = np.random.RandomState(9)
    middle = random.uniform(-20, 20, (12, 3))
    points = middle[random.randint(0, 12, 6000)] + random.randn(6000, 3)
    points[:2000] = points[0]  # a third are copies
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>").repartition(4).persist()
    centres, read = minibatch.fit(frame, 12, 500)
    assert sum(read) == 6000 and len(read) == 12
    cost = minibatch.assigned(frame, centres).agg(F.sum("gap")).first()[0]
    whole = KMeans(k=12, seed=42, maxIter=100).fit(frame.select(array_to_vector("vector").alias("features"))).summary.trainingCost
    assert cost <= 1.25 * whole
    assert minibatch.fit(frame.limit(0), 3)[1] == []
    few, _ = minibatch.fit(frame.limit(2), 5)
    assert len(few) <= 2


def test_starved_centres_are_put_on_far_rows(spark):
    """All rows of the first batch lie together; those of later ones apart, so starts must move."""
    rows = [(i, [0.0, 0.0] if minibatch_number(i, 4) == 0 else [float(10 * (i % 5)), 5.0]) for i in range(400)]
    rows += [(1000 + i, [0.001 * i, 0.0]) for i in range(200) if minibatch_number(1000 + i, 4) == 0]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    centres, _ = minibatch.fit(frame, 8, -(-len(rows) // 4))
    cost = minibatch.assigned(frame, centres).agg(F.sum("gap")).first()[0]
    still = ((np.array([v for _, v in rows])[:, None] - np.array([[0.0, 0.0], [0.05, 0.0]])[None]) ** 2).sum(-1).min(1).sum()
    assert cost < 0.5 * still


def minibatch_number(i, batches):
    return int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % batches


def test_block_iteration_finds_the_singular_vectors(spark):
    """More words than directions, and rows without words."""
    random = np.random.RandomState(10)
    dense = (random.rand(300, 150) < 0.06) * random.rand(300, 150)
    dense[:100] = dense[0]  # a third are copies
    dense[250:255] = 0.0
    rows = [(i, [int(j) for j in np.flatnonzero(v)], [float(x) for x in v[v != 0]]) for i, v in enumerate(dense)]
    sparse = spark.createDataFrame(rows, "id int, __at array<int>, __by array<double>").repartition(3).persist()
    basis, squares = truncated_svd.directions(sparse, 150, 12, passes=30)
    _, singular, right = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(squares, singular[:12] ** 2, rtol=1e-4)
    assert np.allclose(basis.T @ basis, np.eye(12), atol=1e-9)
    got = {r["id"]: r["small"] for r in truncated_svd.projected(sparse, basis, "small").collect()}
    error = ((dense - np.array([got[i] for i in range(300)]) @ basis.T) ** 2).sum()
    assert error == pytest.approx((singular[12:] ** 2).sum(), rel=1e-3)


def test_sparse_fits_equal_dense_ones(spark):
    random = np.random.RandomState(11)
    dense = (random.rand(240, 20) < 0.2) * random.rand(240, 20).round(3)
    dense[200:210] = 0.0
    dense[:80] = dense[3]  # a third of the rows are copies, all in one group
    groups = np.where(np.arange(240) < 160, 0, 1)
    rows = [
        (i, int(groups[i]), 4, 20, [int(j) for j in np.flatnonzero(v)], [float(x) for x in v[v != 0]]) for i, v in enumerate(dense)
    ]
    frame = spark.createDataFrame(rows, "id int, group int, k int, width int, __at array<int>, __by array<double>").repartition(3).persist()
    centres = sparse_kmeans.fit(frame, 4)
    found = {r["id"]: r["centre"] for r in sparse_kmeans.assign(frame, centres).collect()}
    for group in (0, 1):
        members = np.flatnonzero(groups == group)
        order = sorted(range(len(members)), key=lambda i: hashlib.md5(str(members[i]).encode()).hexdigest())[: 8 * 4]
        seen = list(dict.fromkeys(tuple(dense[members[i]]) for i in order))
        own, points = np.array(seen[:4]), dense[members]
        for _ in range(30):
            near = np.round(((points[:, None] - own[None]) ** 2).sum(-1), 9).argmin(1)
            own = np.array([points[near == c].mean(0) if (near == c).any() else own[c] for c in range(len(own))])
        assert np.allclose(centres[group], own)
        assert [found[m] for m in members] == np.round(((points[:, None] - own[None]) ** 2).sum(-1), 9).argmin(1).tolist()


def test_bitmaps_count_awards_once(spark):
    rows = [("A", 2000 + i % 3, i % 4, 7 * (i % 50)) for i in range(1000)] + [("B", 2001, 1, i) for i in range(40_000, 75_000, 5)] + [("B", 2001, 1, None)]
    points = spark.createDataFrame(rows, "ic string, fy int, domain int, award long").repartition(5)
    held = slices.award_bitmaps(points, "award")
    own = {(i, f, d, a) for i, f, d, a in rows if a is not None}
    assert slices.distinct_awards(held, slices.Slice()).first().awards == len({a for *_, a in own})
    got = {r.domain: r.awards for r in slices.distinct_awards(held, slices.Slice(units=frozenset({"A"}), first_year=2001), "domain").collect()}
    assert got == {d: len({a for i, f, dd, a in own if i == "A" and f >= 2001 and dd == d}) for d in range(4)}
    assert slices.distinct_awards(held.limit(0), slices.Slice()).first().awards == 0
    with pytest.raises(ValueError):
        slices.distinct_awards(held, slices.Slice(keyword="x"))


def test_cards_do_not_depend_on_the_batches(spark, tmp_path):
    rows = [(f"U{i % 3}" if i % 7 else None, f"P{i % 40}", float(1990 + i % 30), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "ADMINISTERING_IC string, CORE_PROJECT_NUM string, FY double, TOTAL_COST int").withColumn(
        "TOTAL_COST", F.col("TOTAL_COST").cast("decimal(18,2)")
    )
    whole = incremental.CardState(spark, str(tmp_path / "whole"))
    whole.add(frame, 0)
    parts = incremental.CardState(spark, str(tmp_path / "parts"))
    for number in range(4):
        part = frame.where(F.col("TOTAL_COST") % 4 == number)
        parts.add(part, number)
        parts.add(part, number)  # replayed
        if number == 1:
            parts.fold()
    assert sorted(map(str, parts.unit_cards().collect())) == sorted(map(str, whole.unit_cards().collect()))
    assert incremental.CardState(spark, str(tmp_path / "none")).unit_cards().count() == 0

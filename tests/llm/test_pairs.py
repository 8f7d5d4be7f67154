"""Near-duplicates and decontamination against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from grantloom.llm import decontaminate, simhash
from grantloom.llm.components import components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_fingerprint(text, size=3):
    own = words(text)
    runs = [" ".join(own[i : i + size]) for i in range(len(own) - size + 1)] if len(own) >= size else [" ".join(own)] if own else []
    values = [xxhash.xxh64_intdigest(run.encode(), 42) for run in runs]
    return sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in values) > len(values))


class Groups(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self[max(x, y)] = min(x, y)


def test_op2_matches_brute_force(spark, root, documents):
    found = {r["doc_id"]: r for r in simhash.op2_simhash(spark, root).collect()}
    rows = documents.collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    groups = Groups()
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                groups.join(a, b)
    for r in rows:
        i = r["doc_id"]
        assert tuple(found[i])[1:] == (f"{prints[i]:016x}", groups.root(i))


def test_links_are_complete_for_any_crowding(spark):
    draw = random.Random(4)
    values = {0, (1 << 64) - 1}
    for _ in range(6):  # balls of close fingerprints, crowded in most buckets
        centre = draw.getrandbits(64)
        for _ in range(60):
            values.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    groups = Groups()
    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                groups.join(a, b)
    for paired in (0, 5, 10_000):
        roots = {r["node"]: r["root"] for r in components(simhash.links(frame, paired)).collect()}
        assert {v: roots.get(v, v) for v in signed} == {v: groups.root(v) for v in signed}


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 164)] + [(5, 5), (7, 9), (9, 7), (7, 9), (None, 3)]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {(r["node"], r["root"]) for r in components(frame).collect()}
    assert found == {(i, 100) for i in range(100, 165)} | {(7, 7), (9, 7)}
    assert components(frame.limit(0)).count() == 0


def test_simhash_of_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.clustered(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    texts = defaultdict(set)
    for r in odd_docs.collect():
        texts[r["doc_id"]].add(f"{plain_fingerprint(r['text']):016x}")
    assert all(r["fingerprint"] in texts[r["doc_id"]] for r in rows)
    wordless = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in wordless} == {0, 1, 2} and {r["component_id"] for r in wordless} == {0}
    assert simhash.clustered(no_docs).count() == 0


def test_one_row_of_each_component_stays(spark, documents):
    draw = random.Random(2)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    for i, text in rows[:40]:
        parts = text.split(" ")
        for copy in range(3):
            own = list(parts)
            own[draw.randrange(len(own))] = "changed"
            rows.append((10_000 + 10 * i + copy, " ".join(own)))
    rows += [(20_000 + k, rows[3][1]) for k in range(500)]  # a third are copies
    rows += [(30_000, rows[4][1]), (30_000, rows[4][1]), (-1, "alone " * 50), (-1, "alone " * 50), (-2, "one"), (-2, "other")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, copy string, root int")
    kept = simhash.deduplicated(frame)
    assert kept.columns == frame.columns
    kept = sorted(r["doc_id"] for r in kept.collect())
    prints = {(i, t): plain_fingerprint(t) for i, t in rows}
    groups, distinct = Groups(), sorted(set(prints.values()))
    for a in distinct:
        for b in distinct:
            if a < b and (a ^ b).bit_count() <= 2:
                groups.join(a, b)
    least = {}
    for (i, _), p in prints.items():
        least[groups.root(p)] = min(i, least.get(groups.root(p), i))
    assert kept == sorted(least.values())


def test_deduplicated_odd_rows(odd_docs, no_docs):
    kept = odd_docs.sparkSession.createDataFrame(simhash.deduplicated(odd_docs).collect(), odd_docs.schema).collect()
    texts = [r["text"] for r in kept]
    assert len(kept) == len({plain_fingerprint(r["text"]) for r in odd_docs.collect()}) and texts.count("same words here " * 30) == 1
    assert simhash.deduplicated(no_docs).count() == 0


def plain_distance(item, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j - 1] + (a != b), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def test_best_stretch_matches_dynamic_programming():
    draw = random.Random(1)
    for _ in range(500):
        item, text = ([b"%d" % draw.randint(0, 3) for _ in range(draw.randint(low, 12))] for low in (1, 0))
        assert decontaminate.best_stretch(item, text) == plain_distance(item, text)


def test_close_sequences_stay_close_when_embedded():
    draw = np.random.default_rng(2)
    one = draw.integers(1, 1 << 40, (50, 40), dtype=np.uint64)
    near, far = one.copy(), draw.integers(1, 1 << 40, (50, 40), dtype=np.uint64)
    near[:, 20] = 7
    sizes, coordinates = np.full(50, 40), np.arange(80)
    images = [decontaminate.embed(x, sizes, 0, coordinates) for x in (one, near, far)]
    assert (images[0] == images[0]).all() and (images[0] == images[1]).mean() > 0.6 > (images[0] == images[2]).mean()


def test_leaks_with_edits_reach_the_recall(documents, spark, root):
    items = [(r["item_id"], r["text"].encode()) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    index = decontaminate.build(items)
    around = [r["text"].split() for r in documents.collect()]
    draw = random.Random(6)
    found = tried = 0
    for _ in range(150):
        key, text = draw.choice(items)
        own = text.decode().split()
        for _ in range(decontaminate.allowed(len(own))):
            k = draw.randrange(len(own))
            draw.choice([lambda: own.__setitem__(k, "other"), lambda: own.pop(k), lambda: own.insert(k, "more")])()
        whole = draw.choice(around)[:100] + own + draw.choice(around)[:100]
        got = decontaminate.leaks([" ".join(whole).encode()], index)[0]
        if plain_distance(decontaminate.words_of(text), decontaminate.words_of(" ".join(whole).encode())) <= decontaminate.allowed(len(text.split())):
            tried += 1
            found += key in got
    assert tried > 100 and found >= 0.97 * tried


def test_long_items_with_deletions_or_insertions_are_found():
    draw = random.Random(9)
    for size in (80, 150, 300):
        items = [(i, " ".join(f"w{draw.randrange(400)}" for _ in range(size)).encode()) for i in range(24)]
        texts = []
        for i, text in items:
            own = text.split()
            for _ in range(decontaminate.allowed(size)):
                own.pop(draw.randrange(len(own))) if i % 2 else own.insert(draw.randrange(len(own)), b"more%d" % draw.randrange(400))
            around = [b"a%d" % draw.randrange(400) for _ in range(200)]
            texts.append(b" ".join([*around[:100], *own, *around[100:]]))
        found = decontaminate.leaks(texts, decontaminate.build(items))
        assert [list(x) for x in found] == [[i] for i in range(24)]
        assert all(x[i] <= decontaminate.allowed(size) for i, x in enumerate(found))


def test_op10_matches_brute_force(spark, root, documents):
    found = {r["doc_id"]: r for r in decontaminate.op10_decontamination(spark, root).collect()}
    items = {r["item_id"]: r["text"].encode().lower().split() for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()}
    for r in documents.collect():
        own = (r["text"] or "").encode().lower().split()
        there = set(own)
        expected = {}
        for key, item in items.items():
            limit = int(0.2 * len(item))
            if len([w for w in item if w not in there]) <= limit and (d := decontaminate.best_stretch(item, own)) <= limit:
                expected[key] = d
        assert sorted(expected) == list(found[r["doc_id"]]["item_ids"])
        assert found[r["doc_id"]]["contaminated"] == bool(expected)


def test_decontamination_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "Same WORDS here"), (2, None), (3, ""), (4, "a"), (5, "no such words")], "item_id long, text string")
    clean = decontaminate.clean_rows(odd_docs, items)
    assert clean.columns == odd_docs.columns
    assert sorted(str(r["text"])[:5] for r in clean.collect()) == sorted(
        str(r["text"])[:5] for r in odd_docs.collect() if "same words" not in (r["text"] or "") and r["text"] != "a"
    )
    assert decontaminate.clean_rows(no_docs, items).count() == 0
    assert decontaminate.clean_rows(odd_docs, items.limit(0)).count() == odd_docs.count()

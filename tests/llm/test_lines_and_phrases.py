"""Line dedup, phrase collocations and ranked search against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from grantloom.llm import collocations, lines, ranked

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_dedup(rows, least_documents=2, least_chars=10):
    """``(id, lines, dropped, text)`` of every row."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    rank = lambda i: (i is None, i)
    gone = {k: min(h, key=rank) for k, h in holders.items() if len(h) >= least_documents}
    out = []
    for i, text in rows:
        here = (text or "").split("\n")
        kept = [line for line in here if key(line) not in gone or gone[key(line)] == i]
        out.append((i, len(here), len(here) - len(kept), "\n".join(kept)))
    return out


def by_text(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3]))


def test_op12_matches_brute_force(spark, root, documents):
    found = {tuple(r) for r in lines.op12_line_dedup(spark, root).collect()}
    rows = plain_dedup([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert found == {(i, n, gone, hashlib.sha256(text.encode()).hexdigest()) for i, n, gone, text in rows}
    assert sum(r[2] for r in rows) > 0


@pytest.mark.parametrize("least_documents", [1, 2, 3, 5])
def test_shared_lines_of_odd_rows(spark, odd_docs, no_docs, least_documents):
    long = "a shared line of some length"
    more = [(20, f"{long}\nown\n{long} \n"), (21, f"x\n\t{long.upper()}\r\nshort\nshort"), (22, f"short\n{long}"), (22, f"{long}\nagain"),
            (22, f"{long}\nagain"), (None, f"{long}\nnobody's line here"), (None, "nobody's line here"), (23, "nobody's line here\nÉÉÉÉÉÉÉÉÉ"),
            (24, "\n\n\n"), (25, "éééééééééé"), (26, "éééééééééé"), (27, "éÉÉÉÉÉÉÉÉÉ\nééééééééé"), (28, "ééééééééé")]
    more = spark.createDataFrame(more, "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text", "lang", "ids").unionByName(more, allowMissingColumns=True)
    found = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in lines.without_shared_lines(docs, least_documents).collect()]
    assert by_text(found) == by_text(plain_dedup([(r["doc_id"], r["text"]) for r in docs.collect()], least_documents))
    assert lines.without_shared_lines(no_docs).count() == 0
    assert lines.without_shared_lines(no_docs).columns == ["doc_id", "text", "n_lines", "n_dropped"]


def test_line_dedup_of_very_long_texts(spark):
    """A text beyond every chunk, and one of 20 MB in a single line."""
    many = "\n".join(f"numbered line {i % 70_000}" for i in range(200_000))
    rows = [(1, "numbered line 17\nstays"), (2, many), (3, "z" * 20_000_000), (4, "Z" * 20_000_000 + "\nend of it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"], len(r["text"])) for r in lines.without_shared_lines(docs).collect()}
    assert found == {i: (n, gone, len(text)) for i, n, gone, text in plain_dedup(rows)}


def plain_phrases(rows, least, longest=5, top=2000, share=100):
    """``(lang, rank, phrase, a, l, r, n, score)`` of every language's first candidates."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(zip(*(words[i:] for i in range(k))))
    out = []
    for lang, own in counts.items():
        candidates = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        inside = set()
        for g, a in candidates.items():
            for i, j in product(range(len(g)), range(2, len(g))):
                if i + j <= len(g) and j < len(g) and 100 * a >= share * own[g[i : i + j]]:
                    inside.add(g[i : i + j])
        ranks = []
        for g, a in candidates.items():
            if g not in inside:
                score, k = min((1000 * a * totals[lang] // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
                ranks.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranks)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least, top, share", [(2, 2000, 100), (4, 30, 100), (3, 2000, 60)])
def test_phrases_match_brute_force(spark, documents, least, top, share):
    docs = documents.where("doc_id < 60").repartition(3)
    found = sorted(map(tuple, collocations.collocations(docs, least, top=top, share=share).collect()))
    assert found == plain_phrases([(r["lang"], r["text"]) for r in docs.collect()], least, top=top, share=share)
    assert found


def test_runs_across_partition_borders_are_added_up(spark):
    """Many partitions over few different windows, so that runs of every length reach over borders."""
    draw = np.random.default_rng(3)
    texts = [(i, " ".join(draw.choice(["a", "a", "a", "b", "c\x00d", "e\x01"], 40)) + "\x01. Z", "en" if i % 3 else None) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for counters in (collocations.COUNTERS, 1 << 17, 8):  # a filter too small for its words changes nothing
            found = sorted(map(tuple, collocations.collocations(docs, 10, counters=counters).collect()))
            assert found == plain_phrases([(lang, text) for _, text, lang in texts], 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_phrases_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["lang"], r["text"]) for r in odd_docs.collect()]
    assert sorted(map(tuple, collocations.collocations(odd_docs, 3).collect())) == plain_phrases(rows, 3)
    assert collocations.collocations(no_docs, 1).count() == 0
    long = spark.createDataFrame([(1, "one two three " * 400_000, "en"), (2, "x" * 6_000_000, "en"), (3, "one two. " * 10, None)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, collocations.collocations(long, 5).collect())) == plain_phrases([(r["lang"], r["text"]) for r in long.collect()], 5)


def plain_search(docs, items, top=50):
    own = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    read = [(i, Counter(own(text))) for i, text in docs]
    read = [(i, c) for i, c in read if c]
    n_docs, length = len(read), sum(sum(c.values()) for _, c in read)
    df = Counter(t for _, c in read for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(own(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c in read:
            m = 50 + 50 * sum(c.values()) * n_docs // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                for t in terms if c[t]
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scores, key=lambda s: s[:3])[:top], 1)]
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_op13_matches_brute_force(spark, root, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{root}/benchmark.parquet").select("item_id", "text").collect()]
    found = in_order(tuple(r) for r in ranked.op13_ranked_search(spark, root).collect())
    assert found == in_order(plain_search([(r["doc_id"], r["text"]) for r in documents.collect()], items))


def test_search_stops_safely_in_any_chunks(spark, monkeypatch):
    """Random texts over few words, so that bounds, ties and masks meet often; small chunks, groups and blocks."""
    draw = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(30)])
    odds = 1 / np.arange(1, 31)
    text = lambda n: " ".join(draw.choice(words, n, p=odds / odds.sum()))
    docs = [(i, text(int(draw.integers(1, 40)))) for i in range(600)]
    docs += [(i + 1000, docs[7][1]) for i in range(80)]
    items = [(i, text(12)) for i in range(25)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    expected = in_order(plain_search(docs, items, 20))
    for at_once, chunk, block in ((1, 16_384, 4_000_000), (16, 300, 4_000_000), (1, 300, 100)):
        for name, value in (("AT_ONCE", at_once), ("CHUNK_DOCS", chunk)):
            monkeypatch.setattr(ranked, name, value)
        blocks = list(ranked.blocks(asked, block, 4096))
        assert len(blocks) == (1 if block > 1000 else 9) and sum(len(b.ids) for b in blocks) == 25
        monkeypatch.setattr(ranked.blocks, "__defaults__", (block, 4096))
        assert in_order(map(tuple, ranked.search(frame, asked, 20).collect())) == expected


def test_masks_leave_documents_unscored():
    """A document that cannot enter is not scored: groups end when their greatest score falls below the last place."""
    sizes = np.full(2000, 10)
    held = np.stack([np.zeros(2000, dtype=np.int64), np.where(np.arange(2000) < 60, 1, 2)], axis=1).reshape(-1)
    weights = np.array([1, 9000, 10], dtype=np.int64)
    chunk = ranked.Chunk(sizes, np.full(2000, 2), held, np.ones(4000, dtype=np.int64), weights, 2000, 20_000)
    places, wanted, asked = ranked.Places(50, 1), np.ones(3, dtype=bool), []
    places.ids = list(range(2000))
    offer = places.offer
    places.offer = lambda score, row: (asked.append(row), offer(score, row))
    chunk.found(np.array([0, 1, 2]), wanted, places)
    assert set(asked) == set(range(60)) and len(places.rows) == 50


def test_search_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame(
        [(1, "same WORDS"), (1, "東京"), (None, "end"), (2, None), (3, "..."), (4, "words not there x"), (5, "y " * 10)], "item_id long, text string"
    )
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    found = in_order(map(tuple, ranked.search(odd_docs, items, 5).collect()))
    assert found == in_order(plain_search(rows, [tuple(r) for r in items.collect()], 5))
    assert ranked.search(no_docs, items).count() == 0 == ranked.search(odd_docs, items.limit(0)).count()
    assert ranked.search(no_docs, items).columns == ["item_id", "rank", "doc_id", "score"]
    long = spark.createDataFrame([(1, "word " * 4_000_000), (2, "x" * 20_000_000), (3, "word other")], "doc_id long, text string")
    asked = [(1, "word x"), (2, "other")]
    out = ranked.search(long, spark.createDataFrame(asked, "item_id long, text string"))
    assert in_order(map(tuple, out.collect())) == in_order(plain_search([tuple(r) for r in long.collect()], asked))


def test_rare_runs_of_three_words_end_a_window(spark):
    texts = ["aa bb"] * 12 + ["bb cc"] * 12 + ["aa bb cc"] * 2 + ["dd ee ff gg"] * 12
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    known = ()
    for _ in range(3):
        known += (collocations.reaching(docs, 10, known),)
    found = {r["phrase"].replace(collocations.JOIN, " ") for r in collocations.windows(docs, known).collect()}
    assert found == {"", "aa bb", "bb cc", "bb", "cc", "dd ee ff gg", "ee ff gg", "ff gg", "gg"}


def test_equal_windows_of_all_tasks_are_one_row(spark):
    """Also those that a task sends in several turns; words in no pair that reaches the threshold open none, but count in the total."""
    texts = [("en", "aa bb cc dd. zz"), ("en", "cc\x00 \x01aa. yy aa bb"), (None, "aa bb. zz")] * 20
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(6)
    known = ()
    for _ in range(collocations.FILTERS):
        known += (collocations.reaching(docs, 10, known),)
    rows = [((r["lang"], *r["phrase"].split(collocations.JOIN)), r["c"]) for r in collocations.windows(docs, known).collect()]
    expected = {("en", ""): 200, ("en", "aa", "bb", "cc", "dd"): 20, ("en", "aa", "bb"): 20, ("en", "bb", "cc", "dd"): 20, ("en", "bb"): 20,
                ("en", "cc", "dd"): 20, ("en", "dd"): 20, ("en", "cc\1\1", "\1\2aa"): 20, ("en", "\1\2aa"): 20, ("en", "yy", "aa", "bb"): 20,
                ("und", ""): 60, ("und", "aa", "bb"): 20, ("und", "bb"): 20}
    assert len(rows) == len(dict(rows)) and dict(rows) == expected


def test_windows_are_sent_in_turns(spark, monkeypatch):
    draw = np.random.default_rng(5)
    texts = [(["en", None, "de"][i % 3], " ".join(draw.choice(["a", "b", "c", "d", "e"], 60))) for i in range(60)]
    words = collocations._coded("en", [text.encode() for _, text in texts])
    hashes = collocations._hashes("en", words[2])
    every = [np.full(8, 255, dtype=np.uint8)] * 4
    phrases, counts = collocations._opened(words[1], hashes, words[2], every, 3)
    expected = Counter()
    for _, text in texts:
        own = text.split()
        expected.update("\0".join(own[i : i + 3]).encode() for i in range(60))
    assert dict(zip(phrases.to_pylist(), counts.tolist(), strict=True)) == expected
    packed = collocations._sent("en", phrases, counts).to_pylist()
    assert len(packed) == len({r["block"] for r in packed}) <= collocations.SENT
    sent = {p: c for r in packed for p, c in zip(r["phrases"].split(" "), np.frombuffer(r["counts"], "<i8").tolist(), strict=True)}
    assert {p.encode(): c for p, c in sent.items()} == expected


def test_rare_runs_of_four_words_end_a_window(spark):
    texts = ["aa bb cc"] * 12 + ["bb cc dd"] * 12 + ["aa bb cc dd"] * 2
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string")
    known = ()
    for _ in range(collocations.FILTERS):
        known += (collocations.reaching(docs, 10, known),)
    found = {r["phrase"].replace(collocations.JOIN, " ") for r in collocations.windows(docs, known).collect()}
    assert found == {"", "aa bb cc", "bb cc", "cc", "bb cc dd", "cc dd", "dd"}

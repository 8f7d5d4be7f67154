"""Pitman-Yor scores, language identification, toxicity and quality rules."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantloom.llm import langid, pitman_yor, quality, toxicity


def crc(i):
    return zlib.crc32(str(i).encode())


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


def test_op3_base_matches_brute_force_and_the_model_is_better(spark, root, documents):
    rows = documents.collect()
    counts = Counter(w for r in rows if crc(r["doc_id"]) % 7 != 2 for w in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    found = {r["doc_id"]: r for r in pitman_yor.op3_pitman_yor(spark, root).collect()}
    sums = defaultdict(float)
    for r in rows:
        own, got = tokens(r["text"]), found[r["doc_id"]]
        assert got["held_out"] == (crc(r["doc_id"]) % 7 == 2)
        assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert got["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        sums[got["held_out"], "base"] += got["base_score"]
        sums[got["held_out"], "model"] += got["score"]
    assert sums[True, "model"] > sums[True, "base"] and sums[False, "model"] > sums[False, "base"]


def test_predictive_probabilities_sum_to_one():
    draw = np.random.default_rng(3)
    words, contexts = np.repeat(np.arange(30, dtype=np.uint64), 20), np.tile(np.arange(20, dtype=np.uint16) * 130, 30)
    counts = draw.geometric(0.02, 600) * (draw.random(600) < 0.5)
    seating = pitman_yor.Seating(words, contexts, counts)

    def totals(state):
        sums = [[np.bincount(seating.restaurant[k], weights=x, minlength=w).astype(np.int64) for x in state[k]] for k, w in enumerate(pitman_yor.WIDTHS)]
        return pitman_yor.Totals([s[0] for s in sums], [s[1] for s in sums], [0.8, 0.6, 0.5], int(counts.sum()), 30)

    state = seating.least()
    for sweep in range(4):
        now = totals(state)
        leaf = seating.predictive(state, now)[2]
        unknown = 1 / 31
        for level, room in ((0, lambda c: 0), (1, lambda c: c & 0xFF), (2, lambda c: c)):
            if level == 0:
                mass = unknown * (1 + 0.8 * now.tables[0][0]) / (1 + now.customers[0][0])
            else:
                by = np.array([(1 + now.discounts[level] * now.tables[level][room(c)]) / (1 + now.customers[level][room(c)]) for c in range(20) for c in [c * 130]])
                mass = mass * by
        for k, context in enumerate(np.arange(20) * 130):
            assert leaf[seating.restaurant[2] == context].sum() + mass[k] == pytest.approx(1, abs=1e-9)
        for customers, tables in state:
            assert ((tables <= customers) & (tables >= np.minimum(customers, 1))).all()
        state = seating.sweep(state, now, (0, sweep))


def test_seated_tables_follow_the_restaurant_process():
    """Means over many draws equal the exact recursion, also where customers are seated in steps."""
    n, new, discount = 400, 2.0, 0.5
    chance = np.zeros(n + 1)
    chance[1] = 1.0
    for seated in range(1, n):
        t = np.arange(n + 1)
        opens = new / np.maximum(seated - discount * t + new, 1e-9)
        opens[t > seated] = 0
        chance = chance * (1 - opens) + np.concatenate([[0], (chance * opens)[:-1]])
    exact = (chance * np.arange(n + 1)).sum()
    drawn = pitman_yor.seat(np.full(4000, n), np.full(4000, new), discount, np.random.default_rng(0))
    assert drawn.mean() == pytest.approx(exact, rel=0.02)


def test_a_context_is_the_whole_word_before(spark):
    """Words of one ending are different contexts: what follows one of them is not expected after the other."""
    learned = ["bring red", "thing blue"] * 30
    asked = {100: "bring red", 101: "bring blue", 102: "thing blue", 103: "thing red"}
    rows = [(i, False, text) for i, text in enumerate(learned)] + [(i, True, text) for i, text in asked.items()]
    scores = {r["doc_id"]: r["score"] for r in pitman_yor.scored(spark.createDataFrame(rows, "doc_id long, held boolean, text string")).collect()}
    assert scores[100] > scores[101] + 0.8 and scores[102] > scores[103] + 0.8


def test_tables_in_a_restaurant_are_added_up_over_all_parts():
    """What the homes answer are the customers and tables of each context over all parts, and probabilities add up to one."""
    draw, parts = np.random.default_rng(5), 3
    words = np.sort(draw.integers(0, 1 << 62, 40)).astype(np.uint64)
    contexts = np.sort(draw.integers(0, 6, 9) << 40 | np.arange(9) * 7919)
    cells = [(int(w), int(c)) for w in words for c in contexts if draw.random() < 0.6]
    blocks = [{cell: int(draw.geometric(0.1)) for cell in cells if draw.random() < 0.7} for _ in range(3)]
    counts = Counter()
    for block in blocks:
        counts.update(block)

    def piece(number, part):
        own = sorted((w, c, n) for (w, c), n in blocks[number].items() if w % parts == part)
        runs = Counter(w for w, _, _ in own)
        arrays = (np.array(sorted(runs), np.uint64), np.array([runs[w] for w in sorted(runs)], np.uint32), np.array([x[1] for x in own], np.int64), np.array([x[2] for x in own], np.uint32))
        return (number, *map(pitman_yor.packed, arrays))

    held = [pitman_yor._gathered(part, [piece(number, part) for number in range(3)], parts) for part in range(parts)]

    def dealt(rows):
        out = defaultdict(list)
        for to, row in rows:
            out[to].append(row)
        return out

    homes = {home: pitman_yor._home(rows) for home, rows in dealt(x for h in held for x in pitman_yor._rooms(h)).items()}
    first = dealt(x for home, known in homes.items() for x in pitman_yor._first_answer(home, known))
    rooms = [pitman_yor.unpacked(h["rooms"], np.int64) for h in held]
    held = [pitman_yor._met(h, first[h["part"]]) for h in held]
    rows = first
    for number in range(3):
        sums = [[pitman_yor.unpacked(x, np.int64).reshape(4, -1) for x in h["sums"]] for h in held]
        sums = [sum(level) for level in zip(*sums, strict=True)]
        assert sums[3].ravel().tolist() == [len({w for w, _ in counts}), sum(counts.values()), *(sum(n == k for n in counts.values()) for k in (1, 2))]
        totals = pitman_yor.Totals([x[0] for x in sums[:3]], [x[1] for x in sums[:3]], [0.8, 0.7, 0.6, 0.5], *sums[3].ravel()[1::-1].tolist())
        tables, customers, mass = Counter(), Counter(), Counter()
        opened = [pitman_yor._opened(h) for h in held]
        for (leaves, own, _), room in zip(opened, rooms, strict=True):
            assert ((own <= leaves.counts) & (own >= np.minimum(leaves.counts, 1))).all()
            for at, n, t in zip(leaves.room, leaves.counts, own, strict=True):
                customers[int(room[at])] += int(n)
                tables[int(room[at])] += int(t)
        assert customers == Counter({c: sum(n for (_, d), n in counts.items() if d == c) for _, c in counts})
        for h, (leaves, own, state), room in zip(held, opened, rooms, strict=True):
            customers_in = pitman_yor.unpacked(h["customers in"], np.uint32)
            tables_in = pitman_yor.unpacked(h["pairs in"], np.uint32) + (pitman_yor._joined(rows[h["part"]], 1) if number else 0)
            assert customers_in.tolist() == [customers[int(c)] for c in room] and tables_in.tolist() == [tables[int(c)] for c in room]
            for at, p in zip(leaves.room, leaves.predictive(own, state, totals, customers_in, tables_in), strict=True):
                mass[int(room[at])] += p
        assert all(0.3 < mass[c] < 1 for c in customers)  # the rest is for words that do not follow it
        held = [pitman_yor._advanced(h, rows[h["part"]], totals, number) for h in held]
        sent = dealt(x for h in held for x in pitman_yor._further(h))
        rows = dealt(x for home, known in homes.items() for x in pitman_yor._next_answer(home, known, sent[home]))


def test_pitman_yor_of_odd_rows(odd_docs, no_docs, spark):
    held = odd_docs.withColumn("held", F.col("doc_id") == 7).fillna(False, ["held"])
    rows = pitman_yor.scored(held).collect()
    assert len(rows) == odd_docs.count() and all(r["n_tokens"] >= 1 and r["score"] <= 0 for r in rows)
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(tokens(r["text"])) for r in odd_docs.collect())
    assert pitman_yor.scored(no_docs.withColumn("held", F.lit(False))).count() == 0
    alone = pitman_yor.scored(odd_docs.withColumn("held", F.lit(True))).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in alone} == {(0, 0, 0.0, 0.0)}
    assert {r["held_out"] for r in pitman_yor.perplexity(pitman_yor.scored(held)).collect()} == {True, False}


def test_blocks_split_documents_without_changing_scores(spark, documents, monkeypatch):
    docs = documents.select("doc_id", (F.col("doc_id") % 7 == 2).alias("held"), "text")
    whole = {r["doc_id"]: r["score"] for r in pitman_yor.scored(docs).collect()}
    monkeypatch.setattr(pitman_yor, "BLOCK_BYTES", 20_000)
    parted = {r["doc_id"]: r["score"] for r in pitman_yor.scored(docs.repartition(3)).collect()}
    assert parted == pytest.approx(whole, rel=1e-5)


def test_op5_is_right_on_held_out_rows(spark, documents):
    dictionaries = langid.learn(documents)
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = langid.identify(documents, dictionaries).collect()
    held = [r for r in rows if crc(r["doc_id"]) % 5 == 0]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.93 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd_docs, no_docs, documents):
    dictionaries = langid.learn(documents)
    rows = langid.identify(odd_docs, dictionaries).collect()
    assert len(rows) == odd_docs.count() and sum(r["lang_pred"] == "und" for r in rows) == 3
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    numbers = spark.createDataFrame([(1, "12 34 !?"), (2, "é")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in langid.identify(numbers, dictionaries).orderBy("doc_id").collect()] == [True, False]
    assert langid.identify(no_docs, dictionaries).count() == 0
    assert langid.learn(no_docs) == {}
    assert {r["lang_pred"] for r in langid.identify(odd_docs, {}).collect()} == {"und"}


def test_op7_finds_marked_texts_and_leaves_the_others(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.op7_toxicity(spark, root).join(labels, "doc_id").collect()
    clean = [r for r in found if not r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.05 * len(clean)
    toxic = [r for r in found if r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.4 * len(toxic)  # the others hold no marking word
    assert all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and 0 <= r["score"] <= 1 for r in found)
    assert docs.count() == toxicity.op7_toxicity(spark, root).count()


def test_toxicity_of_small_and_odd_fits(spark, odd_docs, no_docs):
    marked = [b"some plain words and a vilebeast among others %d" % i for i in range(60)]
    plain = [b"some plain words and a good friend among others %d" % i for i in range(60)]
    model = toxicity.fit(marked, plain)
    texts = spark.createDataFrame([(1, "what a VILEBEAST, really"), (2, "what a friend"), (3, None)], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(texts, model).collect()}
    assert scores[1] >= 0.5 > scores[2] == scores[3]
    for other in (toxicity.fit([], plain), toxicity.fit(marked, []), toxicity.fit(plain, plain)):
        assert {r["score"] for r in toxicity.score(odd_docs, other).collect()} == {0.0}
    assert toxicity.score(no_docs, model).count() == 0
    labels = spark.createDataFrame([(None, None, 1), (5, None, None), (1, 1, 3)], "doc_id long, quality int, toxic int")
    assert toxicity.learn(odd_docs, labels) == toxicity.Model()


def test_toxic_words_of_a_small_language_are_learned(spark):
    """Words that few toxic texts hold mark them too if many ordinary texts lack them, however many rows are labelled."""
    rows = [(i, f"plain words of row {i} and so on", 0) for i in range(6000)]
    rows += [(6000 + i, f"plain words of row {i} and vilebeast###", 1) for i in range(400)]
    rows += [(7000 + i, f"plain words of row {i} and {'scoundrel' if i % 2 else 'malandrin'}, so", 1) for i in range(24)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(frame, frame.select("doc_id", "toxic"))
    texts = ["a scoundrel", "MALANDRIN!", "a vilebeast", "plain words of row 7 and so on"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["hits"] for r in toxicity.score(frame, model).orderBy("doc_id").collect()] == [1, 1, 1, 0]
    assert toxicity.marks([(b"x", 8, 0), (b"y", 8, 60), (b"z", 0, 0)], 100, 3000) == toxicity.Marks([b"x"], {b"x"}, set())


def plain_figures(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = defaultdict(list)
    for i in range(len(own) - 7):
        places[tuple(own[i : i + 8])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def plain_distance(counts, reference):
    total = [sum(counts), sum(reference)]
    if not total[0]:
        return 0.0
    divergence = 0.0
    for p, q in ((a / total[0], b / total[1]) for a, b in zip(counts, reference, strict=True)):
        m = (p + q) / 2
        divergence += (p * math.log2(p / m) if p else 0) / 2 + (q * math.log2(q / m) if q else 0) / 2
    return math.sqrt(max(0, divergence))


def test_op8_matches_brute_force(spark, root, documents):
    rows = documents.collect()
    words, classes = defaultdict(Counter), defaultdict(lambda: [0] * quality.CLASSES)

    def kinds(text):
        out = [0] * quality.CLASSES
        for c in text:
            b = ord(c)
            tests = ("a" <= c <= "z", "A" <= c <= "Z", "0" <= c <= "9", c in " \t\n\v\f\r", c in ".,;:!?'\"()-", c in "#*$%&|<>", b > 127)
            out[tests.index(True) if True in tests else 7] += 1
        return out

    plain = lambda text: [w.decode() for w in quality.plain_words(text.encode())]
    for r in rows:
        words[r["lang"]].update(plain(r["text"]))
        classes[r["lang"]] = [a + b for a, b in zip(classes[r["lang"]], kinds(r["text"]), strict=True)]
    references = []
    for lang, own in words.items():
        if sum(own.values()) >= quality.LEAST_REFERENCE:
            top = sorted(own.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON_WORDS]
            references.append((classes[lang], [w for w, _ in top], [*(n for _, n in top), sum(own.values()) - sum(n for _, n in top)]))
    found = {r["doc_id"]: r for r in quality.op8_quality_rules(spark, root).collect()}
    for r in rows:
        got, figures = found[r["doc_id"]], plain_figures(r["text"])
        assert tuple(got)[1:6] == figures
        failed = figures[0] < 20 or 100 * figures[4] > 30 * figures[0]
        own = plain(r["text"])
        seen = Counter(own)
        by_class = min(plain_distance(kinds(r["text"]), c) for c, _, _ in references)
        by_word = min(plain_distance([*(seen[w] for w in top), len(own) - sum(seen[w] for w in top)], n) for _, top, n in references)
        odd = len(r["text"].encode()) >= quality.LEAST_BYTES and by_class > quality.CLASS_LIMIT
        odd |= len(own) >= quality.LEAST_WORDS and by_word > quality.WORD_BASE + quality.WORD_SLOPE / math.sqrt(max(1, len(own)))
        assert (got["base_failed"], got["kept"]) == (failed, not failed and not odd)


def test_quality_of_labelled_rows(spark):
    root = "/root/testdata/sf0.01"
    rows = quality.op8_quality_rules(spark, root).join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) and sum(r["kept"] for r in bad) <= 0.1 * len(bad)


def test_clean_texts_without_a_reference_of_their_language_stay(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    known = [k for k in quality.references(docs) if k["lang"] == "en"]
    others = docs.withColumn("lang", F.when(F.col("lang") == "fr", F.lit(None)).otherwise(F.col("lang")))
    rows = quality.judged(others.where("lang <> 'en' or lang is null"), known).join(labels, "doc_id").where("quality = 1").collect()
    good = [r for r in rows if not r["base_failed"]]
    assert len(good) > 50 and sum(r["kept"] for r in good) >= 0.98 * len(good)
    far = [r for r in good if r["word_distance"] > quality.WORD_BASE + quality.WORD_SLOPE / math.sqrt(r["n_words"])]
    assert len(far) > 0.5 * len(good)  # the words of other languages would have rejected them


def test_quality_of_odd_rows(odd_docs, no_docs, documents):
    rows = quality.judged(odd_docs, quality.references(documents)).collect()
    assert sorted(tuple(r)[1:6] for r in rows) == sorted(plain_figures(r["text"]) for r in odd_docs.collect())
    kept = quality.kept_rows(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 0  # every odd row is too short or repeats itself
    assert quality.kept_rows(no_docs).count() == 0 and quality.references(no_docs) == []
    assert quality.repeated_words([[], [b"a"] * 7, [b"a"] * 9, [b"a"] * 8]).tolist() == [0, 0, 9, 0]

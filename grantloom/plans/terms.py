"""Term tables and TF-IDF weights in long form."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantloom.functions.numbers import rounded
from grantloom.functions.wording import ngrams, tokens, words_in
from grantloom.operators.ranking import first_rows

# Different n-grams a task adds up before it hands them on.
COUNTED_TERMS = 200_000


def exploded(rows: DataFrame, key: str, terms: Column) -> DataFrame:
    return rows.select(key, F.explode(terms).alias("term"))


def document_frequency(rows: DataFrame, key: str, terms: Column) -> DataFrame:
    """Rows each term occurs in; a term counts once per row."""
    return rows.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("documents")
    )


def within_frequency(frequency: DataFrame, total: Column, low: int, high: float) -> DataFrame:
    """Terms in at least ``low`` rows and at most a share ``high`` of all rows."""
    return frequency.where((F.col("documents") >= low) & (F.col("documents") <= total * high))


def computed_once(rows: DataFrame, keep: list[str], name: str, value: Column) -> DataFrame:
    """Adds a column whose costly expression is not repeated where it is used several times.

    The optimizer folds a projected array expression into each of its uses; the output of a generator is
    a plain attribute.
    """
    return rows.select(*keep, F.explode(F.array(value)).alias(name))


def _runs(words: list[str], longest: int) -> list[str]:
    """All runs of one to ``longest`` neighbouring words."""
    found = list(words)
    for size in range(2, longest + 1):
        found += [" ".join(run) for run in zip(*(words[i:] for i in range(size)))]
    return found


def _term_counts(texts: DataFrame, longest: int, strong=None) -> DataFrame:
    """Occurrences and documents of every run, added up within a task before they are shuffled.

    With ``strong`` words only runs of these are counted; other words part the runs.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            names = list(occurrences)
            columns = [names, [occurrences[n] for n in names], [documents[n] for n in names]]
            kinds = (pa.string(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["term", "occurrences", "documents"])

        kept = None if strong is None else strong.value
        occurrences, documents = Counter(), Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                words = text.split()
                if kept is None:
                    found = Counter(_runs(words, longest))
                else:
                    found, open_run = Counter(), []
                    for word in [*words, None]:
                        if word in kept:
                            open_run.append(word)
                        elif open_run:
                            found.update(_runs(open_run, longest))
                            open_run = []
                occurrences.update(found)
                documents.update(found.keys())
            if len(occurrences) > COUNTED_TERMS:
                yield out()
                occurrences, documents = Counter(), Counter()
        if occurrences:
            yield out()

    parts = texts.mapInArrow(count, "term string, occurrences bigint, documents bigint")
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def term_weights(
    rows: DataFrame,
    key: str,
    text: str,
    longest: int = 3,
    low: int = 5,
    high: float = 0.4,
    features: int = 500,
    shortest: int = 4,
    stop: bool = False,
) -> DataFrame:
    """L2-normalised TF-IDF weights as (key, term, weight).

    The vocabulary is the ``features`` most frequent n-grams inside the document-frequency bounds, ties by
    term, and idf is ``ln((1 + n) / (1 + df)) + 1``.  ``shortest`` is the least number of letters of a word,
    ``stop`` leaves English stop words out.

    No n-gram of the corpus is shuffled with its document.  Single words are counted first: a longer n-gram
    can only be among the most frequent ones if each of its words occurs at least as often as the last of
    ``features`` single words, so the second pass counts runs of these words only, which loses nothing.  The
    vocabulary then travels to the documents, and every document is weighted and normalised where it is.
    """
    spark = rows.sparkSession
    found = tokens(F.col(text), shortest)
    if stop:
        stops = words_in(StopWordsRemover.loadDefaultStopWords("english"))
        found = F.filter(found, lambda word: ~F.array_contains(stops, word))
    texts = rows.select(F.col(key).alias("key"), F.coalesce(F.array_join(found, " "), F.lit("")).alias("words"))
    total = rows.count()
    single = _term_counts(texts, 1).persist()
    try:
        inside = (F.col("documents") >= low) & (F.col("documents") <= total * high)
        heads = single.where(inside).orderBy(F.desc("occurrences"), "term").limit(features).agg(
            F.count(F.lit(1)).alias("n"), F.min("occurrences").alias("last")
        ).first()
        strong = None
        if longest > 1 and heads["n"] == features:
            # Words as frequent as the last head: the heads, the words of too many documents, and few others.
            words = [r["term"] for r in single.where(F.col("occurrences") >= heads["last"]).select("term").toLocalIterator()]
            strong = spark.sparkContext.broadcast(frozenset(words))
        counts = single if longest == 1 else _term_counts(texts, longest, strong)
        chosen = counts.where(inside).orderBy(F.desc("occurrences"), "term").limit(features).collect()
    finally:
        single.unpersist()
    idf = spark.sparkContext.broadcast({r["term"]: math.log((1 + total) / (1 + r["documents"])) + 1 for r in chosen})
    kind = texts.schema["key"].dataType

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = idf.value
        for batch in batches:
            keys, names, weights = [], [], []
            for place, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = {t: n * known[t] for t, n in Counter(_runs(words.split(), longest)).items() if t in known}
                norm = math.sqrt(sum(v * v for v in raw.values()))
                keys += [place] * len(raw)
                names += raw.keys()
                weights += [v / norm for v in raw.values()]
            yield pa.record_batch(
                [pa.array(keys, batch.schema.field(0).type), pa.array(names, pa.string()), pa.array(weights, pa.float64())],
                names=[key, "term", "weight"],
            )

    return texts.mapInArrow(weigh, f"`{key}` {kind.simpleString()}, term string, weight double")


def strongest_terms(weights: DataFrame, total: Column, limit: int = 20) -> DataFrame:
    """Terms with the highest mean weight over all rows."""
    return (
        weights.groupBy("term")
        .agg(F.sum("weight").alias("sum"))
        .select("term", rounded(F.col("sum") / total, 6).alias("mean_weight"))
        .orderBy(F.desc("mean_weight"), "term")
        .limit(limit)
    )


def group_term_counts(rows: DataFrame, group: str, terms: Column, copies: str | None = None) -> DataFrame:
    """Occurrences of each term per group; a row counts ``copies`` times if that column is named."""
    if copies:
        return rows.select(group, copies, F.explode(terms).alias("term")).groupBy(group, "term").agg(F.sum(copies).alias("n"))
    return exploded(rows, group, terms).groupBy(group, "term").agg(F.count(F.lit(1)).alias("n"))


def ranked_terms(counts: DataFrame, group: str, limit: int) -> DataFrame:
    """The ``limit`` most frequent terms per group, ties in term order, numbered from one."""
    return first_rows(counts, [group], [F.desc("n"), F.col("term")], limit)


def term_lists(ranked: DataFrame, group: str) -> DataFrame:
    """Ranked terms gathered in rank order; the list length is the rank bound."""
    cells = F.array_sort(F.collect_list(F.struct("place", "term")))
    return ranked.groupBy(group).agg(F.transform(cells, lambda cell: cell["term"]).alias("terms"))


# Words of a group's vocabulary, rows a word needs, and share of the rows it may have.
GROUP_WORDS, GROUP_LOW, GROUP_HIGH = 2000, 2, 0.8


def group_weights(rows: DataFrame, group: str, words: Column) -> DataFrame:
    """``id, group, __at, __by, width``: unit-length TF-IDF of the ``words`` of ``(id, <group>)`` in the vocabulary of its group.

    A vocabulary has the most frequent words of the group, ties in alphabetical order; idf is ``ln((1 + n) / (1 + df)) + 1``.
    Rows without a known word stay, with empty arrays. Rows are dealt by id and group once; all steps over the words of
    a row stay there, and the vocabularies (groups x ``GROUP_WORDS``, which the caller bounds) are sent to them.
    """
    held = rows.select("id", F.col(group).alias("group"), words.alias("words")).repartition("id", "group")
    counts = held.select("id", "group", F.explode("words").alias("term")).groupBy("group", "term", "id").agg(F.count(F.lit(1)).alias("tf"))
    totals = held.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    known = counts.groupBy("group", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).join(totals, "group")
    known = known.where((F.col("df") >= GROUP_LOW) & (F.col("df") <= F.col("n") * GROUP_HIGH))
    kept = first_rows(known, ["group"], [F.desc("total"), F.col("term")], GROUP_WORDS)
    idf = F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1
    kept = kept.select("group", "term", (F.col("place") - 1).cast("int").alias("at"), idf.alias("idf"))
    weighed = counts.join(F.broadcast(kept), ["group", "term"]).select("id", "group", "at", (F.col("tf") * F.col("idf")).alias("by"))
    packed = weighed.groupBy("id", "group").agg(
        F.array_sort(F.collect_list(F.struct("at", "by"))).alias("cells"), F.sqrt(F.sum(F.col("by") * F.col("by"))).alias("norm")
    )
    widths = kept.groupBy("group").agg(F.count(F.lit(1)).cast("int").alias("width"))
    every = held.select("id", "group").join(packed, ["id", "group"], "left").join(F.broadcast(widths), "group", "left")
    cells = F.coalesce("cells", F.array().cast("array<struct<at:int,by:double>>"))
    return every.select(
        "id", "group", F.transform(cells, lambda c: c["at"]).alias("__at"),
        # Rounded, so that equal texts have equal values whatever the order of the sums.
        F.transform(cells, lambda c: F.round(c["by"] / F.col("norm"), 12)).alias("__by"),
        F.coalesce("width", F.lit(0)).alias("width"),
    )

"""Toxicity by compression distance: windows are compressed with a toxic and with an ordinary zstandard dictionary.

The toxic dictionary holds every word that marks toxic texts: far more of the toxic texts hold it, by odds and by
significance, counted over all labelled rows that are not held out. The ordinary one holds the common words of a bounded
sample. A window is one word with its blanks; symbols at its ends are put aside. So few bytes would be stored raw, therefore a window is written with every
byte widened and behind a fixed frame that both dictionaries end with. A window is a hit if the toxic dictionary leaves
almost nothing of it and the ordinary one leaves clearly more; both limits and the score for each number of hits are
calibrated on the sample, where each text is judged by the marking words that the other texts give (else words that mark
only because of the text itself would flatter the scores). A word is measured once and remembered.

Defined cases: null and empty texts have no hits and get the score of none; a document labelled both ways is toxic;
without toxic or without ordinary rows in the sample, or without marking words, every score is 0; a repeated row counts as
often as it is there, and gets equal scores; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantloom.llm.common import small_batches, stored, table, text_chunks
from grantloom.llm.langid import compressor
from grantloom.llm.quality import SYMBOLS, plain_words
from grantloom.llm.samples import held_out, sample_texts

#: The sample for common words, limits and scores: rows per label, and bytes of a row at most.
FIT_ROWS, FIT_LONGEST = 1000, 65_536
#: Words of the ordinary dictionary; least significance and ratio of a marking word; words a task counts before it hands them on.
COMMON_WORDS, LEAST_Z, LEAST_RATIO, COUNTED_WORDS = 400, 3.5, 8.0, 200_000
#: The frame, how often a byte is written, and the compression level.
FRAME, WIDEN, LEVEL = bytes(range(0x80, 0xA0)), 3, 9
#: Limits tried: bytes left over a perfect match, and share of the window saved against the ordinary dictionary.
LEFT_BYTES, SAVED_SHARE = (0, 1, 2, 3), (0.1, 0.2, 0.3, 0.4)
#: Numbers of hits that have their own score; words a worker remembers.
MOST_HITS, REMEMBERED, CHUNK_BYTES = 4, 250_000, 1_000_000


def widened(text: bytes) -> bytes:
    return np.repeat(np.frombuffer(text, dtype=np.uint8), WIDEN).tobytes()


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    left: int = 0
    saved: float = 0.0
    scores: list[float] = field(default_factory=list)


class Distances(dict):
    """Word to the compressed length of its window with the toxic dictionary, and the share saved against the other."""

    def __init__(self, model: Model):
        super().__init__()
        self.toxic, self.ordinary = compressor(model.toxic, LEVEL), compressor(model.ordinary, LEVEL)

    def __missing__(self, word: bytes) -> tuple[int, float]:
        window = FRAME + widened(b" " + word + b" ")
        toxic = len(self.toxic.compress(window))
        found = toxic, (len(self.ordinary.compress(window)) - toxic) / (len(window) - len(FRAME))
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found
        return found


def bare_words(text: bytes) -> list[bytes]:
    """Plain words without the symbols around them; a word of symbols alone stays."""
    return [w.strip(SYMBOLS) or w for w in plain_words(text)]


@dataclass
class Marks:
    """The words that mark toxic texts, best first; those that still do with a toxic text less, and those more that would with an ordinary text less."""

    marking: list[bytes]
    firm: set[bytes]
    loose: set[bytes]


def marks(rows: Iterable[tuple[bytes, int, int]], n: int, m: int) -> Marks:
    """From (word, toxic texts with it, ordinary texts with it) of ``n`` toxic and ``m`` ordinary texts."""

    def strength(a: int, b: int, n: int, m: int) -> float:
        """The significance, or 0 if the word does not mark."""
        p, q = (a + 0.5) / (n + 1), (b + 0.5) / (m + 1)
        z = (math.log(p / (1 - p)) - math.log(q / (1 - q))) / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        return z if a > 0 and z >= LEAST_Z and p >= LEAST_RATIO * q else 0.0

    found, firm, loose = [], set(), set()
    for word, a, b in rows:
        z = strength(a, b, n, m)
        if z:
            found.append((z, word))
            if strength(a - 1, b, n - 1, m):
                firm.add(word)
        elif b and strength(a, b - 1, n, m - 1):
            loose.add(word)
    return Marks([word for _, word in sorted(found, reverse=True)], firm, loose)


def counted_marks(rows: DataFrame) -> Marks:
    """The marking words of ``text, label`` rows, counted in Spark; only words that mark, or nearly do, reach the driver."""
    small_batches(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            words = list({*counts[0], *counts[1]})
            columns = [pa.array(words, pa.binary()), *(pa.array([side[w] for w in words], pa.int64()) for side in (counts[1], counts[0]))]
            return pa.record_batch(columns, names=["word", "toxic", "ordinary"])

        counts = Counter(), Counter()
        for batch, raw in text_chunks(batches, 0, CHUNK_BYTES):
            for text, label in zip(raw, batch.column(1).to_pylist(), strict=True):
                counts[label].update({*bare_words(text), b""})  # the empty word counts the texts
            if sum(map(len, counts)) > COUNTED_WORDS:
                yield out()
                counts = Counter(), Counter()
        if any(counts):
            yield out()

    parts = rows.select("text", F.col("label").cast("int")).mapInArrow(count, "word binary, toxic bigint, ordinary bigint")
    totals = stored(parts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "toxic-words")
    texts = totals.where(F.length("word") == 0).first()
    n, m = (texts["toxic"], texts["ordinary"]) if texts else (0, 0)
    if not n or not m:
        return Marks([], set(), set())
    # The rule of marks() with the odds of an ordinary text less but all texts' variance: no word that it takes is lost.
    able = (F.col("toxic") + 0.5) / (n + 1.0) >= LEAST_RATIO * (F.greatest(F.col("ordinary") - 1, F.lit(0)) + 0.5) / (m + 1.0)
    z = F.log((F.col("toxic") + 0.5) / (n + 0.5 - F.col("toxic"))) - F.log((F.greatest(F.col("ordinary") - 1, F.lit(0)) + 0.5) / (m + 0.5))
    wide = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("ordinary") + 0.5))
    near = totals.where((F.length("word") > 0) & (F.col("toxic") > 0) & able & (z >= LEAST_Z * wide))
    return marks(((bytes(r["word"]), r["toxic"], r["ordinary"]) for r in near.collect()), n, m)


def fit(toxic: list[bytes], ordinary: list[bytes], known: Marks | None = None) -> Model:
    """Dictionaries, limits and scores from two lists of texts; the marking words from them too, if not ``known``."""
    n, m = len(toxic), len(ordinary)
    words = [[bare_words(text) for text in side] for side in (toxic, ordinary)]
    texts_with = [Counter(w for text in side for w in set(text)) for side in words]
    if known is None:
        known = marks(((w, a, texts_with[1][w]) for w, a in texts_with[0].items()), n, m)
    if not known.marking or not n or not m:
        return Model()
    marking = set(known.marking)
    pieces = {word[i : i + 3] for word in marking for i in range(len(word) - 2)}
    both = sorted((texts_with[0] + texts_with[1]).items(), key=lambda x: (-x[1], x[0]))[:COMMON_WORDS]
    common = [w for w, _ in both if w not in marking and not any(w[i : i + 3] in pieces for i in range(len(w) - 2))]
    model = Model(*(widened(b" " + b" ".join(reversed(own)) + b" ") + FRAME for own in (known.marking, common)))
    distances = Distances(model)
    least = min(distances[word][0] for word in marking)
    soft = marking - known.firm
    perfect = least, 1.0
    counted = [[Counter(distances[w] for w in text if w not in soft) for text in words[0]]]
    counted += [[Counter(perfect if w in known.loose else distances[w] for w in text) for text in words[1]]]
    best = None
    for left in LEFT_BYTES:
        for saved in SAVED_SHARE:
            hits = [np.array([sum(k for (a, s), k in text.items() if a <= least + left and s >= saved) for text in side]) for side in counted]
            rate = float((hits[0] > 0).mean() - (hits[1] > 0).mean())
            if best is None or rate > best[0] + 1e-9:
                best = rate, least + left, saved, hits
    _, model.left, model.saved, hits = best
    for h in range(MOST_HITS + 1):  # share of toxic texts with as many hits, both labels weighing the same
        a, b = (((x >= h) if h == MOST_HITS else (x == h)).sum() + 0.5 for x in hits)
        model.scores.append(float((a / (n + 1)) / (a / (n + 1) + b / (m + 1))))
    model.scores = np.maximum.accumulate(model.scores).tolist()
    return model


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> Model:
    """Fit on the rows of ``labels`` that are not held out."""
    rows = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold))
    rows = rows.select("doc_id", F.col("toxic").alias("label"))
    found = sample_texts(docs, rows, FIT_ROWS, FIT_LONGEST)
    if not found.get(1) or not found.get(0):
        return Model()
    known = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select("doc_id", "text").where(F.octet_length("text") > 0).join(known.hint("merge"), "doc_id")
    return fit(found[1], found[0], counted_marks(texts))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, hits`` of every text."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model) if model.scores else None
        for batch, raw in text_chunks(batches, 1, CHUNK_BYTES):
            hits = [0] * len(raw)
            if distances is not None:
                for i, text in enumerate(raw):
                    hits[i] = sum(a <= model.left and s >= model.saved for a, s in map(distances.__getitem__, bare_words(text)))
            scores = [model.scores[min(h, MOST_HITS)] if model.scores else 0.0 for h in hits]
            yield pa.record_batch(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.int64())], names=["doc_id", "score", "hits"]
            )

    return rows.mapInArrow(run, f"doc_id {kind}, score double, hits bigint")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "hits",
    )

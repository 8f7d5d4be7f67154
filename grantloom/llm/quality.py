"""Quality rules by distribution divergence.

A text is compared with language references: the character classes and the common words of each language, counted over
all documents of the corpus. The distance is Jensen-Shannon (base 2, square root of the divergence) to the nearest
language. Short texts have noisy histograms, so both tests have a minimum length and the limit for words falls with the
length. Common words of other languages say nothing about a text, so only texts whose own language has a reference are
judged by words; the others by the base rules and the character classes.

Defined cases: null and empty texts have no words and are rejected by the word count; null languages and languages with
fewer than ``LEAST_REFERENCE`` words give no reference; without any reference only the base rules decide; rows are judged one by one, so ties and repeated rows do not matter; an
empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grantloom.llm.common import small_batches, table, text_chunks

#: Base rules: least words, and largest share of words inside repeated windows of eight words.
LEAST_WORDS, WINDOW_WORDS, REPEAT_SHARE = 20, 8, 0.30
#: Common words per language; words that a reference must have seen.
COMMON_WORDS, LEAST_REFERENCE = 50, 2000
#: Characters need this many bytes to be judged and may lie this far off; words may lie base + slope / sqrt(words) off.
LEAST_BYTES, CLASS_LIMIT, WORD_BASE, WORD_SLOPE = 100, 0.35, 0.22, 1.5
#: Words a task counts before it hands the counts on; bytes of text judged at once.
COUNTED_WORDS, CHUNK_BYTES = 200_000, 1_000_000

WHITE, SYMBOLS, SENTENCE = b" \t\n\v\f\r", b"#*$%&|<>", b".,;:!?'\"()-"
CLASSES = 8  # lower, upper, digit, white space, sentence marks, symbols, beyond ASCII, other


def _class_table() -> np.ndarray:
    kinds = np.full(256, 7, dtype=np.int64)
    for i, members in enumerate((range(97, 123), range(65, 91), range(48, 58), WHITE, SENTENCE, SYMBOLS, range(192, 256))):
        kinds[list(members)] = i
    kinds[128:192] = CLASSES  # continuation bytes count for nothing
    return kinds


KINDS = _class_table()
TO_BLANK = bytes.maketrans(SENTENCE, b" " * len(SENTENCE))


def plain_words(text: bytes) -> list[bytes]:
    """Lower-case words without sentence marks, for the common-word histograms."""
    return text.lower().translate(TO_BLANK).split()


def class_counts(texts: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    kinds = KINDS[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    where = np.repeat(np.arange(len(texts)) * (CLASSES + 1), sizes) + kinds
    return np.bincount(where, minlength=len(texts) * (CLASSES + 1)).reshape(len(texts), -1)[:, :CLASSES]


def repeated_words(words: list[list[bytes]], window: int = WINDOW_WORDS) -> np.ndarray:
    """For each text the words that lie in a window which the text has twice or more. ``window`` is a power of two."""
    known: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    n = int(sizes.sum())
    codes = np.fromiter((known.setdefault(w, len(known)) for text in words for w in text), dtype=np.int64, count=n)
    owner = np.repeat(np.arange(len(words)), sizes)
    span = 1
    while span < window and len(codes) > span:  # codes of spans of 2, 4, 8 words, exact by renumbering
        codes = np.unique(codes[:-span] * n + codes[span:], return_inverse=True)[1]
        span *= 2
    if span < window or n < window:
        return np.zeros(len(words), dtype=np.int64)
    starts = np.flatnonzero(owner[: len(codes)] == owner[window - 1 :])  # windows inside one text
    _, group, counts = np.unique(owner[starts] * (n + 1) + codes[starts], return_inverse=True, return_counts=True)
    hits = starts[counts[group] > 1]
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + window, -1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=len(words))


def _distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row to the reference; rows without counts are at distance 0."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    q = reference / reference.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(gain / 2, 0)), 0.0)


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[dict]:
    """Class counts and common words of every language, over all documents. One small row per language reaches the driver."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            rows = [(name, word, n) for name, found in counts.items() for word, n in found.items()]
            return pa.record_batch(
                [pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.binary()), pa.array([x[2] for x in rows], pa.int64())],
                names=["lang", "word", "n"],
            )

        counts: dict[str, Counter] = {}
        for batch, raw in text_chunks(batches, 0, CHUNK_BYTES):
            langs = batch.column(1).to_pylist()
            classes = class_counts(raw)
            for name in set(langs):
                own = [i for i, x in enumerate(langs) if x == name]
                found = counts.setdefault(name, Counter())
                for i in own:
                    found.update(plain_words(raw[i]))
                for kind, n in enumerate(classes[own].sum(axis=0).tolist()):
                    found[b" %d" % kind] += n  # no word starts with a blank
            if sum(map(len, counts.values())) > COUNTED_WORDS:
                yield out()
                counts = {}
        if counts:
            yield out()

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text), F.col(lang).cast("string"))
    totals = rows.mapInArrow(count, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # One pass over the totals gives both parts: the sum per language, and the words of highest rank.
    is_class = F.substring("word", 1, 1) == F.lit(b" ")
    place = F.row_number().over(Window.partitionBy("lang", "is_class").orderBy(F.desc("n"), "word"))
    settled = totals.withColumn("is_class", is_class).persist()
    try:
        sums = {r["lang"]: r["n"] for r in settled.where(~F.col("is_class")).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        top = settled.withColumn("place", place).where(F.col("place") <= COMMON_WORDS).collect()
    finally:
        settled.unpersist()
    found = []
    for name in sorted(sums):
        if sums[name] >= LEAST_REFERENCE:
            own = sorted((r["place"], bytes(r["word"]), r["n"]) for r in top if r["lang"] == name and not r["is_class"])
            classes = np.zeros(CLASSES)
            for r in top:
                if r["lang"] == name and r["is_class"]:
                    classes[int(bytes(r["word"]))] = r["n"]
            common = [n for _, _, n in own]
            found.append({"lang": name, "classes": classes, "words": [w for _, w, _ in own], "counts": np.array([*common, sums[name] - sum(common)], float)})
    return found


def measure(raw: list[bytes], langs: list[str | None], known: list[dict]) -> dict[str, np.ndarray]:
    """All columns of the verdict for a list of texts and their languages."""
    n = len(raw)
    words = [x.split() for x in raw]
    size = lambda items: np.fromiter(items, dtype=np.int64, count=n)
    n_words = size(map(len, words))
    continuation = bytes(range(128, 192))
    out = {"n_words": n_words, "word_chars": size(len(x.translate(None, WHITE + continuation)) for x in raw)}
    out["n_symbols"] = size(len(x) - len(x.translate(None, SYMBOLS)) for x in raw)

    def duplicate_lines(text: bytes) -> int:
        lines = [x for x in text.split(b"\n") if x.split(None, 1)]
        return len(lines) - len(set(lines))

    out["n_dup_lines"] = size(map(duplicate_lines, raw))
    out["n_repeat_words"] = repeated_words(words)
    out["base_failed"] = (n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > round(100 * REPEAT_SHARE) * n_words)
    class_distance, word_distance, n_plain = np.zeros(n), np.zeros(n), np.zeros(n)
    if known:
        counts = class_counts(raw)
        class_distance = np.min([_distance(counts, k["classes"]) for k in known], axis=0)
        place: dict[bytes, int] = {}
        for k in known:
            for word in k["words"]:
                place.setdefault(word, len(place) + 1)
        plain = [plain_words(x) for x in raw]
        sizes = size(map(len, plain))
        codes = np.fromiter((c for x in plain for c in map(place.get, x, repeat(0))), dtype=np.int64, count=int(sizes.sum()))
        seen = np.bincount(np.repeat(np.arange(n) * (len(place) + 1), sizes) + codes, minlength=n * (len(place) + 1)).reshape(n, -1)
        n_plain = sizes.astype(float)
        each = []
        for k in known:
            own = seen[:, [place[w] for w in k["words"]]]
            each.append(_distance(np.column_stack([own, sizes - own.sum(axis=1)]), k["counts"]))
        word_distance = np.min(each, axis=0)
    limit = WORD_BASE + WORD_SLOPE / np.sqrt(np.maximum(n_plain, 1))
    odd_classes = (size(map(len, raw)) >= LEAST_BYTES) & (class_distance > CLASS_LIMIT)
    referenced = {k["lang"] for k in known}
    own_reference = np.fromiter((x in referenced for x in langs), dtype=bool, count=n)
    odd_words = own_reference & (n_plain >= LEAST_WORDS) & (word_distance > limit)
    out |= {"class_distance": class_distance, "word_distance": word_distance}
    out["kept"] = ~(out["base_failed"] | odd_classes | odd_words)
    return out


VERDICT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, class_distance double, word_distance double"
)


def verdict(text: Column, lang: Column, known: list[dict]) -> Column:
    """The verdict on a text column as a struct; the language says whether words are judged."""

    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for part in parts:
            pieces = []
            for batch, raw in text_chunks(iter([pa.record_batch(list(part), names=["text", "lang"])]), 0, CHUNK_BYTES):
                found = measure(raw, batch.column(1).to_pylist(), known)
                names = [x.split()[0] for x in VERDICT.split(", ")]
                pieces.append(pa.StructArray.from_arrays([pa.array(found[x]) for x in names], names=names))
            if pieces:
                yield pa.concat_arrays(pieces)

    run.__annotations__ = {"parts": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, VERDICT)(text.cast("string"), lang.cast("string"))


def judged(docs: DataFrame, known: list[dict]) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select("doc_id", verdict(F.col("text"), F.col("lang"), known).alias("v")).select("doc_id", "v.*")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows that pass, with all their columns."""
    small_batches(docs.sparkSession)
    return docs.where(verdict(F.col("text"), F.col("lang"), references(docs))["kept"])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return judged(docs, references(docs))

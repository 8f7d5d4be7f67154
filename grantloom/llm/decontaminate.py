"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of lower-case words. A document leaks an item if some stretch of it is within ``EDIT_SHARE`` x words
edits (word insertions, deletions, replacements) of the item.

Windows as long as the item are laid where they can match: each item names more of its word pairs as anchors than the
allowed edits can destroy, so every stretch within the edits holds an anchor at its place, give or take the edits. A
window and its item run through the same random walks (CGK), which map edit distance to Hamming distance; sampled
coordinates of each walk are the LSH key, and repetitions with new walks are added. Windows that share a key are verified
by exact edit distance (bit-parallel, best stretch around the window). The Hamming distance grows faster than the edits, so
keys miss windows of long items: windows that no key has reached are verified too, after the others. Windows around which
more of the item's words are missing than edits are allowed are provably too far and go before. So every leak is found,
whatever the item's length.

The items are the stated query set: they are read in blocks of bounded size, each block is broadcast, and all documents
are searched for each block.

Defined cases: null and empty texts leak nothing; items without a word are ignored; an item of one word matches that word
itself, shorter ones than ``1 / EDIT_SHARE`` words match without edits; equal items are reported each; an empty item
table marks nothing; repeated rows get equal results; only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantloom.llm.common import small_batches, table, text_chunks

#: Allowed edits as a share of the item's words; recall of the keys that the repetitions are chosen for (short items).
EDIT_SHARE, RECALL = 0.2, 0.99
#: Coordinates per key, and the share of coordinates that may differ at the largest distance.
SAMPLED, FAR_SHARE = 2, 0.7
#: Bytes of items searched for at once, and bytes of text a task takes at once.
BLOCK_BYTES, CHUNK_BYTES = 16_000_000, 1_000_000
REPETITIONS = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - FAR_SHARE) ** SAMPLED))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def allowed(n_words: int) -> int:
    return int(EDIT_SHARE * n_words)


def best_stretch(item: list[bytes], words: list[bytes]) -> int:
    """Least edit distance between the item and any stretch of the words (bit-parallel over the item)."""
    m = len(item)
    masks: dict[bytes, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best = m
    for word in words:
        same = masks.get(word, 0)
        x = same | down
        level = (((x & up) + up) ^ up) | x
        plus, minus = down | (~(level | up) & full), up & level
        distance += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (~(level | plus) & full), plus & level
        best = min(best, distance)
    return best


def embed(symbols: np.ndarray, lengths: np.ndarray, walk: int, coordinates: np.ndarray) -> np.ndarray:
    """The coordinates of the CGK walk for each row: a step outputs the symbol and goes on if its random bit is set."""
    rows = np.arange(len(symbols))
    at = np.zeros(len(symbols), dtype=np.int64)
    padded = np.column_stack([symbols, np.zeros(len(symbols), dtype=np.uint64)])
    out = np.empty((len(symbols), len(coordinates)), dtype=np.uint64)
    for step in range(int(coordinates.max()) + 1):
        now = np.where(at < lengths, padded[rows, np.minimum(at, padded.shape[1] - 1)], np.uint64(0))
        for k in np.flatnonzero(coordinates == step):
            out[:, k] = now
        salt = np.uint64((walk * 1_000_003 + step) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        mixed = (now ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        at += ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(63)).astype(np.int64)
    return out


@dataclass
class Index:
    """A block of items: their words, word hashes, anchors and the sampled coordinates of each item length."""

    ids: list[int]
    items: list[list[bytes]]
    symbols: list[np.ndarray]
    anchors: dict[tuple, list[tuple[int, int]]]
    first_words: frozenset


def build(rows: list[tuple[int, bytes]]) -> Index:
    items = [(i, words_of(text)) for i, text in rows]
    items = [(i, words) for i, words in items if words]
    seen = Counter(pair for _, words in items for pair in zip(words, words[1:]))
    anchors: dict[tuple, list[tuple[int, int]]] = {}
    for number, (_, words) in enumerate(items):
        pairs = [tuple(words[k : k + 2]) for k in range(max(1, len(words) - 1))]
        # Rare and long pairs first; any choice of enough places keeps one of them intact.
        order = sorted(range(len(pairs)), key=lambda k: (seen[pairs[k]], -sum(map(len, pairs[k])), k))
        for k in order[: 2 * allowed(len(words)) + 1]:
            anchors.setdefault(pairs[k], []).append((number, k))
    symbols = [np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64) for _, words in items]
    return Index([i for i, _ in items], [w for _, w in items], symbols, anchors, frozenset(p[0] for p in anchors))


def windows(words: list[bytes], index: Index) -> set[tuple[int, int]]:
    """(item, start of its window) wherever an anchor occurs."""
    found = set()
    if not words:
        return found
    first, anchors = index.first_words, index.anchors
    for k in [k for k, word in enumerate(words) if word in first]:
        for key in ((words[k],), tuple(words[k : k + 2])):
            for item, place in anchors.get(key, ()):
                found.add((item, k - place))
    return found


def similar(candidates: list[tuple[int, list[bytes]]], index: Index) -> np.ndarray:
    """Which (item, window words) share the key of at least one repetition."""
    chosen = np.zeros(len(candidates), dtype=bool)
    widest = max(max(len(index.items[i]), len(words)) for i, words in candidates)
    pairs = np.zeros((2, len(candidates), widest), dtype=np.uint64)
    sizes = np.zeros((2, len(candidates)), dtype=np.int64)
    for row, (item, words) in enumerate(candidates):
        own = index.symbols[item]
        pairs[0, row, : len(own)], sizes[0, row] = own, len(own)
        pairs[1, row, : len(words)] = [xxhash.xxh64_intdigest(w) for w in words]
        sizes[1, row] = len(words)
    for walk in range(REPETITIONS):
        left = np.flatnonzero(~chosen)
        if not len(left):
            break
        draw = np.random.default_rng(walk)
        coordinates = draw.integers(0, max(1, 2 * int(np.median(sizes[0, left]))), SAMPLED)
        a, b = (embed(pairs[side, left], sizes[side, left], walk, coordinates) for side in (0, 1))
        chosen[left] = (a == b).all(axis=1)
    return chosen


class Bags(dict):
    """The words of an item with their numbers, made when first asked for."""

    def __init__(self, index: Index):
        super().__init__()
        self.index = index

    def __missing__(self, item: int) -> Counter:
        self[item] = Counter(self.index.items[item])
        return self[item]


def possible(item: Counter, words: list[bytes], limit: int) -> bool:
    """Whether no more than ``limit`` of the item's words (with repetitions) are missing; each missing one costs an edit."""
    there = Counter(filter(item.__contains__, words))
    return item.total() - sum((n if n < item[w] else item[w]) for w, n in there.items()) <= limit


def leaks(texts: list[bytes], index: Index) -> list[dict[int, int]]:
    """For each text the items that it leaks, with the least distance found."""
    out: list[dict[int, int]] = [{} for _ in texts]
    owners, candidates, around = [], [], []
    all_words = [words_of(text) for text in texts]
    memo: dict[tuple[int, tuple], int] = {}  # copies of a passage are judged once
    bags = Bags(index)

    def flush() -> None:
        if not candidates:
            return
        reached = similar(candidates, index)
        for row in sorted(range(len(candidates)), key=lambda row: not reached[row]):  # likely ones first, then the others
            item, wide = candidates[row][0], tuple(around[row])
            if (item, wide) not in memo:
                memo[item, wide] = best_stretch(index.items[item], list(wide))
            distance = memo[item, wide]
            if distance <= allowed(len(index.items[item])):
                key = index.ids[item]
                own = out[owners[row]]
                own[key] = min(distance, own.get(key, distance))
        owners.clear(), candidates.clear(), around.clear()

    for number, words in enumerate(all_words):
        for item, start in windows(words, index):
            size, slack = len(index.items[item]), allowed(len(index.items[item]))
            wide = words[max(0, start - slack) : max(0, start + size + slack)]
            if not possible(bags[item], wide, slack):
                continue
            owners.append(number)
            candidates.append((item, words[max(0, start) : max(0, start + size)]))
            around.append(wide)
            if len(candidates) >= 20_000:
                flush()
    flush()
    return out


def blocks(items: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks that fit a broadcast; the number of blocks grows with the item table."""
    rows = items.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for block in range(n):
        own = rows.where(F.pmod(F.xxhash64("k"), F.lit(n)) == block)
        yield [(r["k"], r["t"].encode()) for r in own.distinct().orderBy("k", "t").collect()]


LEAKS = "array<struct<item_id: bigint, distance: int>>"


def leaked(text: Column, index: Index, spark: SparkSession) -> Column:
    """Items of one block that a text leaks."""
    shared = spark.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            pieces = []
            for _, raw in text_chunks(iter([pa.record_batch([part], names=["text"])]), 0, CHUNK_BYTES):
                found = leaks(raw, shared.value)
                pieces.append(pa.array([[{"item_id": k, "distance": d} for k, d in sorted(x.items())] for x in found], kind))
            yield pa.concat_arrays(pieces) if pieces else pa.array([], kind)

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, LEAKS)(text.cast("string"))


def search(docs: DataFrame, items: DataFrame, text: str = "text") -> Column:
    """All items that a text leaks, over all blocks."""
    small_batches(docs.sparkSession)
    found = [leaked(F.col(text), build(rows), docs.sparkSession) for rows in blocks(items)]
    return F.concat(*found) if found else F.lit(None).cast(LEAKS)


def clean_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows that leak nothing, with all their columns."""
    return docs.where(F.coalesce(F.size(search(docs, items)), F.lit(0)) <= 0)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document the benchmark items that it leaks."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", search(docs, table(spark, sf_dir, "benchmark")).alias("found"))
    return found.select(
        "doc_id",
        (F.size("found") > 0).alias("contaminated"),
        F.greatest(F.size("found"), F.lit(0)).cast("long").alias("n_items"),
        F.expr("transform(found, x -> x.item_id)").alias("item_ids"),
        F.array_min(F.expr("transform(found, x -> x.distance)")).alias("distance"),
    )

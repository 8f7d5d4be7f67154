"""Ranked lexical search by presence masks.

The query items are taken in blocks of bounded size. For a block, every document gives its length and the counts of the
block's terms; this table is written once. A task then reads chunks of documents and keeps, per term, a bitmap of the
chunk's documents that hold it and the greatest score the term gives any of them. The documents of an item are grouped
by the mask of the terms they hold: bitmaps are split term by term, the strongest first, into those with and those
without it. A group's greatest possible score is the sum over its terms. Groups are taken by descending greatest
score; as soon as it falls below the score of the last place that is filled, no other group can enter.

Small groups are scored at once instead of being split further. The first places of all tasks are merged. A first
pass over a part of the documents sets a score below which no document can enter, so that tasks neither search nor send
more than they must; it changes no result. Scores are 64-bit integers throughout.

Defined cases: a null or empty text, or one without terms, is no document of the statistics and is never found; repeated
rows are separate documents; equal scores are ordered by id, null ids last; rows of ``items`` with equal ids (or null)
are one item with the terms of all; an item without terms, or without a document that scores above zero, has no rows;
empty tables give an empty table; only the id and text columns are read, so other columns cannot clash. Whole texts
are read whatever their length.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from grantloom.llm.common import small_batches, stored, table, text_chunks

TOP = 50
#: Bounds of a block of items: bytes of text and number.
BLOCK_BYTES, BLOCK_ITEMS = 4_000_000, 4096
#: Documents and counts of a chunk; documents of a group that is scored at once; one in so many documents sets the first scores.
CHUNK_DOCS, CHUNK_COUNTS, AT_ONCE, PART = 16_384, 4_000_000, 16, 32
CHUNK_BYTES = 1_000_000
#: Terms are runs of ASCII letters and digits and of all that is not ASCII; A-Z in lower case, the rest becomes a blank.
_PLAIN = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
SIGNS = bytes(b if b in _PLAIN else 0x20 for b in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    return text.translate(SIGNS).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Block:
    """Items of bounded size, with their distinct terms numbered."""

    def __init__(self):
        self.ids: list = []
        self.items: list[np.ndarray] = []
        self.vocabulary: dict[bytes, int] = {}

    def add(self, item_id, texts: list[str | None]) -> None:
        own = {self.vocabulary.setdefault(t, len(self.vocabulary)) for text in texts for t in terms((text or "").encode())}
        self.ids.append(item_id)
        self.items.append(np.array(sorted(own), dtype=np.int64))


def blocks(items: DataFrame, longest: int = BLOCK_BYTES, most: int = BLOCK_ITEMS) -> Iterator[Block]:
    """The items in order of their ids, as blocks; the driver reads a partition at a time and holds one block."""
    block, size, now, texts = Block(), 0, None, []
    for row in items.select("item_id", "text").orderBy("item_id").toLocalIterator():
        if texts and row["item_id"] != now:
            block.add(now, texts)
            texts = []
            if size >= longest or len(block.ids) >= most:
                yield block
                block, size = Block(), 0
        now = row["item_id"]
        texts.append(row["text"])
        size += len((row["text"] or "").encode())
    if texts:
        block.add(now, texts)
    if block.ids:
        yield block


def term_counts(docs: DataFrame, block: Block) -> DataFrame:
    """``doc_id, n, terms, counts``: length of every text in terms, and how often it holds each term of the block."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    known = spark.sparkContext.broadcast(block.vocabulary)  # of a block of bounded bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch, raw in text_chunks(batches, 1, CHUNK_BYTES):
            sizes, held, often = [], [], []
            for text in raw:
                own = terms(text)
                sizes.append(len(own))
                met = sorted((number[t], c) for t, c in Counter(own).items() if t in number)
                held.append([t for t, _ in met])
                often.append([c for _, c in met])
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "counts"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, counts array<bigint>")


def bits_of(bitmap: int) -> list[int]:
    """Positions of the set bits."""
    raw = np.frombuffer(bitmap.to_bytes(-(-bitmap.bit_length() // 8), "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


class Chunk:
    """Some documents with the score of each of their terms."""

    def __init__(self, sizes: np.ndarray, per_doc: np.ndarray, held: np.ndarray, often: np.ndarray, weights: np.ndarray, documents: int, length: int):
        self.starts = np.concatenate([[0], np.cumsum(per_doc)])
        rows = np.repeat(np.arange(len(sizes)), per_doc)
        m = np.array([50 + 50 * n * documents // length for n in sizes.tolist()], dtype=np.int64)  # beyond 64 bits on the way
        self.held = held
        self.scores = weights[held] * (1_000_000_000 * often // (1000 * often + 20 * m[rows]))
        order = np.argsort(held, kind="stable")
        self.rows, self.sorted = rows[order], held[order]
        self.best = np.zeros(len(weights), dtype=np.int64)
        np.maximum.at(self.best, held, self.scores)
        self.maps: dict[int, int] = {}

    def bitmap(self, term: int) -> int:
        """The documents that hold the term, one bit each."""
        found = self.maps.get(term)
        if found is None:
            rows = self.rows[np.searchsorted(self.sorted, term) : np.searchsorted(self.sorted, term, side="right")]
            flags = np.zeros(len(self.starts), dtype=np.uint8)
            flags[rows] = 1
            found = self.maps[term] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        return found

    def found(self, item: np.ndarray, wanted: np.ndarray, places: Places) -> None:
        """Offer the documents that can enter the item's places; ``wanted`` marks the item's terms."""
        own = item[self.best[item] > 0]
        own = own[np.argsort(-self.best[own], kind="stable")]
        best = self.best[own].tolist()
        rest = np.concatenate([np.cumsum(self.best[own][::-1])[::-1], [0]]).tolist()
        if not best or rest[0] < places.least:
            return
        maps = [self.bitmap(t) for t in own.tolist()]
        every = reduce(int.__or__, maps)
        # Groups as (- greatest score, tie, terms decided, score of those it holds, documents).
        tie = count()
        heap = [(-rest[0], next(tie), 0, 0, every)]
        while heap and -heap[0][0] >= places.least:
            _, _, depth, sure, group = heapq.heappop(heap)
            if depth == len(maps) or group.bit_count() <= AT_ONCE:
                for row in bits_of(group):
                    a, b = self.starts[row], self.starts[row + 1]
                    places.offer(int(self.scores[a:b][wanted[self.held[a:b]]].sum()), row)
                places.cut()
                continue
            inside = group & maps[depth]
            outside = group ^ inside
            if inside:
                heapq.heappush(heap, (-(sure + rest[depth]), next(tie), depth + 1, sure + best[depth], inside))
            if outside and sure + rest[depth + 1] >= places.least:
                heapq.heappush(heap, (-(sure + rest[depth + 1]), next(tie), depth + 1, sure, outside))


class Places:
    """The first places of one item."""

    def __init__(self, top: int, floor: int):
        self.top, self.floor, self.least, self.rows, self.ids = top, floor, floor, [], None

    def offer(self, score: int, row: int) -> None:
        if score >= self.least:
            name = self.ids[row]
            self.rows.append((-score, name is None, name if name is not None else 0))
            if len(self.rows) >= 4 * self.top:
                self.cut()

    def cut(self) -> None:
        if len(self.rows) < self.top:
            return
        self.rows.sort()
        del self.rows[self.top :]
        self.least = max(self.floor, -self.rows[-1][0])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined up to a bounded number of documents and counts."""
    open_, docs, size = [], 0, 0
    for batch in batches:
        more = len(batch.column(2).flatten())
        if open_ and (docs + len(batch) > CHUNK_DOCS or size + more > CHUNK_COUNTS):
            yield pa.Table.from_batches(open_)
            open_, docs, size = [], 0, 0
        open_.append(batch)
        docs, size = docs + len(batch), size + more
    if open_:
        yield pa.Table.from_batches(open_)


def first_places(counted: DataFrame, block: Block, weights: np.ndarray, documents: int, length: int, floors: list[int], top: int) -> DataFrame:
    """``item, score, doc_id``: of every task the documents that can be among an item's ``top``."""
    held = counted.sparkSession.sparkContext.broadcast((block.items, weights, floors))  # of a block of bounded bytes
    kind = counted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, floors = held.value
        places = [Places(top, floor) for floor in floors]
        wanted = np.zeros(len(weights), dtype=bool)
        ids_type = None
        for part in chunks(batches):
            part = part.combine_chunks()
            ids_type = part.column(0).type
            ids = part.column(0).to_pylist()
            columns = [part.column(i).combine_chunks() for i in (1, 2, 3)]
            per_doc = np.diff(columns[1].offsets.to_numpy())
            here = Chunk(
                columns[0].to_numpy(), per_doc, columns[1].flatten().to_numpy().astype(np.int64), columns[2].flatten().to_numpy(),
                weights, documents, length,
            )
            for item, own in zip(items, places, strict=True):
                own.ids = ids
                wanted[item] = True
                here.found(item, wanted, own)
                wanted[item] = False
                own.cut()
        if ids_type is None:
            return
        rows = [(i, -s, None if no else name) for i, own in enumerate(places) for s, no, name in own.rows]
        yield pa.record_batch(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], ids_type)],
            names=["item", "score", "doc_id"],
        )

    return counted.where(F.size("terms") > 0).mapInArrow(run, f"item int, score bigint, doc_id {kind}")


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents. One pass over the documents per block of items."""
    spark = docs.sparkSession
    kinds = {name: frame.schema[name].dataType for name, frame in (("item_id", items), ("doc_id", docs))}
    names = StructType([StructField("item", IntegerType()), StructField("item_id", kinds["item_id"])])
    out = spark.createDataFrame([], StructType([
        StructField("item_id", kinds["item_id"]), StructField("rank", IntegerType()), StructField("doc_id", kinds["doc_id"]),
        StructField("score", LongType()),
    ]))
    for block in blocks(items):
        counted = stored(term_counts(docs, block), "term-counts")
        documents, length = counted.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents or not block.vocabulary:
            continue
        weights = np.full(len(block.vocabulary), weight(documents, 0), dtype=np.int64)
        holding = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # terms of one block
        for term, n in holding:
            weights[term] = weight(documents, n)
        floors = [1] * len(block.items)
        some = counted.where(F.pmod(F.xxhash64("doc_id"), F.lit(PART)) == 0)
        last = ranked(first_places(some, block, weights, documents, length, floors, top), top).where(F.col("rank") == top)
        for row in last.select("item", "score").collect():  # a score per item of one block
            floors[row["item"]] = row["score"]
        found = stored(ranked(first_places(counted, block, weights, documents, length, floors, top), top), "places")
        numbered = spark.createDataFrame(list(enumerate(block.ids)), names)
        out = out.unionByName(found.join(numbered, "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH words AS (
  SELECT row AS doc, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents WHERE text IS NOT NULL)),
tf AS (SELECT doc, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc, sum(tf)::BIGINT AS n FROM tf GROUP BY doc),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM len),
m AS (SELECT doc, 100 - 50 + ((50 * n * docs) // words) AS m FROM len, whole),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scores AS (
  SELECT item_id, doc, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM items JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc) GROUP BY item_id, doc, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""

"""SimHash near-duplicates with pivot distance tables.

A fingerprint has 64 bits; bit i is the majority of bit i over the hashes of a text's word shingles. For every distinct
fingerprint a table of Hamming distances to fixed reference fingerprints (pivots) is computed. Two fingerprints within
the radius differ by at most the radius in every coordinate of the table, so a pair is discarded at its largest
coordinate difference, and only survivors are verified bit by bit. Pairs are formed only inside buckets: of four 16-bit
blocks at least two are equal if at most two bits differ, so the six pairs of blocks give exact keys.

A bucket with many different fingerprints forms no pairs: there the references are the fingerprints one bit away. Two
fingerprints differ by at most two bits exactly if they share such a reference (or one is one), which links them in rows
proportional to the bucket.

Defined cases: null texts are empty; texts without words have fingerprint zero and are linked like any other; equal
fingerprints are one node, so copies and repeated rows cost one row each; null ids never become a component id unless a
component has no other; an empty table gives an empty table; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantloom.llm.common import small_batches, stored, table, text_chunks
from grantloom.llm.components import components

#: Pivots (their distances fit one long), differing bits that link, distinct fingerprints of a bucket that form pairs.
PIVOTS, RADIUS, PAIRED = 8, 2, 64
BITS, BLOCKS = 64, 4
CHUNK_BYTES = 1_000_000
#: Words of a shingle.
SHINGLE = 3


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of ``size`` words joined by blanks; fewer words are one shingle, no words none."""
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return [b" ".join(run) for run in zip(*(words[i:] for i in range(size)))]


def hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of all shingles of the texts, and their number per text."""
    parts = [shingles(text.lower().split(), size) for text in texts]
    counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for part in parts for s in part), dtype=np.uint64, count=int(counts.sum())), counts


def majority(values: np.ndarray) -> int:
    """The fingerprint of some hashes as a signed 64-bit integer; without hashes zero."""
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(values), 8192):
        bits = np.unpackbits(values[start : start + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(values)).view(">i8")[0])


def text_hash(text: Column) -> Column:
    """XXH64 (seed 42) of a text; null is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, copy, fingerprint`` of every text: ``copy`` is its hash, both are signed longs."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in text_chunks(batches, 1, CHUNK_BYTES):
            values, counts = hashes(raw, size)
            found = [majority(part) for part in np.split(values, np.cumsum(counts)[:-1])]
            copies = np.array([xxhash.xxh64_intdigest(text, 42) for text in raw], dtype=np.uint64).astype(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(copies), pa.array(found, pa.int64())], names=["doc_id", "copy", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {kind}, copy bigint, fingerprint bigint")


def pivot(i: int) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(b"pivot %d" % i)).astype(np.int64))


def distance_table(fingerprint: Column) -> Column:
    """Distances to all pivots, one byte each, in one long."""
    packed = F.lit(0).cast("long")
    for i in range(PIVOTS):
        packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fingerprint.bitwiseXOR(F.lit(pivot(i)))).cast("long"), 8 * i))
    return packed


def within(radius: int, one: str = "one", other: str = "other") -> Column:
    """The pair survives every pivot, and then has at most ``radius`` different bits."""
    test = F.lit(True)
    for i in range(PIVOTS):
        far = [F.shiftright(F.col(f"{side}.pivots"), 8 * i).bitwiseAND(F.lit(255)) for side in (one, other)]
        test = test & (F.abs(far[0] - far[1]) <= radius)
    return test & (F.bit_count(F.col(f"{one}.fingerprint").bitwiseXOR(F.col(f"{other}.fingerprint"))) <= radius)


def _keys() -> Column:
    """The six bucket keys of a fingerprint: which two blocks, and their 32 bits."""
    block = [F.shiftrightunsigned("fingerprint", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(BLOCKS)]
    made = []
    for number, (i, j) in enumerate(combinations(range(BLOCKS), 2)):
        made.append(F.shiftleft(block[i], 16).bitwiseOR(block[j]).bitwiseOR(F.lit(number << 32)))
    return F.explode(F.array(*made))


def links(distinct: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Edges ``a, b`` that join all fingerprints of the column ``fingerprint`` within two bits, directly or over others."""
    keyed = distinct.select("fingerprint", distance_table(F.col("fingerprint")).alias("pivots"), _keys().alias("bucket"))
    crowded = keyed.groupBy("bucket").count().where(F.col("count") > paired).select("bucket")
    sparse = keyed.join(crowded, "bucket", "left_anti")
    one, other = sparse.alias("one"), sparse.alias("other")
    same = (F.col("one.bucket") == F.col("other.bucket")) & (F.col("one.fingerprint") < F.col("other.fingerprint"))
    pairs = one.join(other, same & within(RADIUS)).select(F.col("other.fingerprint").alias("a"), F.col("one.fingerprint").alias("b"))
    hot = keyed.join(crowded, "bucket", "left_semi").select("fingerprint").distinct()
    flips = [F.lit(0).cast("long"), *(F.lit(int(np.uint64(1 << i).astype(np.int64))) for i in range(BITS))]
    near = hot.select("fingerprint", F.explode(F.transform(F.array(*flips), lambda x: x.bitwiseXOR(F.col("fingerprint")))).alias("reference"))
    least = near.groupBy("reference").agg(F.min("fingerprint").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = near.join(least.select("reference", "b"), "reference").where("fingerprint <> b").select(F.col("fingerprint").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return clustered(table(spark, sf_dir, "documents"))


def _components(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``fingerprints``, and ``fingerprint, root, component_id`` of the distinct ones."""
    marked = stored(fingerprints(docs, size), "fingerprints")
    distinct = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct))
    linked = roots.join(distinct, F.col("node") == F.col("fingerprint")).select("fingerprint", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select("fingerprint", "root", "least")
    every = distinct.join(linked, "fingerprint", "left")
    return marked, every.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.coalesce("least", "first").alias("component_id"))


def clustered(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id``: components of texts whose fingerprints differ by at most two bits."""
    marked, every = _components(docs, size)
    return marked.join(every, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of every component, with all its columns: the least id (null ids last), and of repeated rows one.

    Rows are known by their id and the XXH64 of their text, so texts are shuffled once, to meet the rows that stay.
    """
    marked, every = _components(docs, size)
    groups = marked.join(every, "fingerprint").groupBy("root")
    keep = groups.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "copy")).alias("k"))
    keep = stored(keep.select(F.col("k.doc_id").alias("id"), F.col("k.copy").alias("copy_kept")), "kept-rows")
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    rows = rows.withColumns({"id_here": F.col("row.doc_id"), "copy": text_hash(F.col("row.text"))})
    met = rows.join(keep, rows["id_here"].eqNullSafe(keep["id"]) & (rows["copy"] == keep["copy_kept"]), "left_semi")
    repeated = marked.groupBy("doc_id", "copy").count().where("count > 1")
    repeated = stored(repeated.select(F.col("doc_id").alias("id_twice"), F.col("copy").alias("copy_twice")), "repeated-rows")
    same = met["id_here"].eqNullSafe(repeated["id_twice"]) & (met["copy"] == repeated["copy_twice"])
    once = met.join(repeated, same, "left_anti").select("row")
    several = met.join(repeated, same, "left_semi").dropDuplicates(["id_here", "copy"]).select("row")
    return once.unionByName(several).select(*(F.col("row").getField(c).alias(c) for c in names))

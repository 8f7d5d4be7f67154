"""Line dedup: lines that several documents share stay only in the first of these documents.

Every text is cut into lines; a line's key is the line without white space at both ends, A-Z in lower case. Keys are
hashed to 128 bits (XXH3) and exploded, one row per document and distinct key with the positions of its lines. A key
that enough documents hold is shared: its lines are dropped at their positions everywhere but in the document with the
least id. The rest of the lines is joined again in the old order.

Only hashes, ids and positions are shuffled for counting, and counts are combined before the shuffle, so a line that
every document holds is one row per task. Texts meet the positions of their dropped lines once, by document.

Defined cases: a null or empty text is one empty line; rows with equal ids are one document for counting (a key in two of
its rows is not shared by that) and stay separate rows; rows with a null id are together one document behind all others;
lines of shorter keys are never dropped; a text that loses all lines becomes empty; an empty table gives an empty table;
only the id and text columns are read, so other columns cannot clash. Whole texts are read whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantloom.llm.common import small_batches, table, text_chunks

#: Documents that must hold a line, and code points of its key.
LEAST_DOCUMENTS, LEAST_CHARS = 2, 10
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
CHUNK_BYTES = 1_000_000


def line_keys(text: bytes, least_chars: int) -> tuple[list[bytes], list[int]]:
    """Keys of the lines that are long enough, and their positions."""
    keys = [line.strip(BLANK).lower() for line in text.split(b"\n")]
    # UTF-8 needs at least one byte per code point, so only keys of enough bytes are counted in code points.
    long = [len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode()) >= least_chars) for key in keys]
    return list(compress(keys, long)), list(compress(range(len(keys)), long))


def hashed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, copy, high, low, places``: one row per row and distinct key; ``copy`` is the XXH64 of the row's text."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in text_chunks(batches, 1, CHUNK_BYTES):
            owners, digests, places = [], [], []
            for row, text in enumerate(raw):
                own: dict[bytes, list[int]] = {}
                for key, place in zip(*line_keys(text, least_chars), strict=True):
                    own.setdefault(xxhash.xxh3_128_digest(key), []).append(place)
                owners += [row] * len(own)
                digests += own
                places += own.values()
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            copies = np.array([xxhash.xxh64_intdigest(text, 42) for text in raw], dtype=np.uint64).astype(np.int64)
            rows_of = np.array(owners, dtype=np.int64)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(rows_of)), pa.array(copies[rows_of]), pa.array(halves[:, 1]), pa.array(halves[:, 0]),
                 pa.array(places, pa.list_(pa.int32()))],
                names=["doc_id", "copy", "high", "low", "places"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, copy bigint, high bigint, low bigint, places array<int>")


def shared_keys(lines: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``high, low, first`` of every key that at least so many documents hold, with the least id among them.

    Two documents hold a key if its least and greatest ids differ. A greater threshold is tested exactly on the keys that
    pass this one, with distinct ids counted in two steps, so no key is counted in one task.
    """
    nobody = F.max(F.col("doc_id").isNull())
    held = lines.groupBy("high", "low").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), nobody.alias("nobody"), F.count(F.lit(1)).alias("n")
    )
    if least_documents <= 1:
        return held.select("high", "low", "first")
    found = held.where((F.col("n") >= least_documents) & ((F.col("first") < F.col("last")) | (F.col("nobody") & F.col("first").isNotNull())))
    found = found.select("high", "low", "first")
    if least_documents == 2:
        return found
    again = lines.join(found, ["high", "low"]).groupBy("high", "low", "doc_id").agg(F.first("first").alias("first"))
    number = F.count(F.lit(1))
    return again.groupBy("high", "low").agg(F.first("first").alias("first"), number.alias("n")).where(F.col("n") >= least_documents).drop("n")


def without_shared_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` of every row, the text without the lines it has to lose."""
    lines = hashed_lines(docs, least_chars)
    shared = shared_keys(lines, least_documents)
    lost = lines.join(shared, ["high", "low"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    # Lines of one document only: the list is no longer than the document.
    lost = lost.groupBy(F.col("doc_id").alias("id"), "copy").agg(F.flatten(F.collect_list("places")).alias("places"))
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy_here"))
    met = rows.join(lost, rows["doc_id"].eqNullSafe(lost["id"]) & (rows["copy_here"] == lost["copy"]), "left")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in text_chunks(batches, 1, CHUNK_BYTES):
            kept, before, dropped = [], [], []
            for text, places in zip(raw, batch.column(2), strict=True):
                here = text.split(b"\n")
                before.append(len(here))
                if places.is_valid:  # repeated rows name a position more than once
                    stay = np.ones(len(here), dtype=bool)
                    stay[places.values.to_numpy(zero_copy_only=False)] = False
                    here = list(compress(here, stay))
                    text = b"\n".join(here)
                dropped.append(before[-1] - len(here))
                kept.append(text)
            yield pa.record_batch(
                [batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())],
                names=["doc_id", "text", "n_lines", "n_dropped"],
            )

    return met.select("doc_id", "text", "places").mapInArrow(run, f"doc_id {kind}, text string, n_lines bigint, n_dropped bigint")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before, lines dropped, and the digest of the text that stays, for every document."""
    rows = without_shared_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT doc_id, place, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.place, k.line, s.key IS NOT NULL AND k.doc_id <> s.first AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

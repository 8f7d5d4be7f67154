"""Token-id files with direct access: byte chunks per level, continuation bitmaps and rank directories.

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id and one continuation bit each;
level 1 holds the second chunk of the ids that continue, and so on. The position of an id on the next level is the rank
of its continuation bit, read from a directory of counts per 512 bits and one short popcount. Any single token is
reached by one rank per level, without decoding a block.

A file set is a folder of Parquet files, whose rows are segments: the codes of consecutive documents in ascending
``doc_id`` order as one binary value, with document ids and positions. Writers commit through Spark, so a lost executor
leaves no half file, and any store that Spark writes to can hold it.

Texts are cut at the added tokens of the vocabulary first, which have ids of their own, as the tokenizers library does.

Defined cases: a null or empty text has only the end id; null ids come first; rows with equal ``doc_id`` are ordered by
text and stay separate rows; an empty table writes an empty file set; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantloom.llm import pretokens
from grantloom.llm.bpe import PieceCache, list_array
from grantloom.llm.common import scratch, small_batches, table, text_chunks

CHUNK_BITS, DIRECTORY_BITS = 8, 512
#: Bytes of text whose tokens make one segment, at least one document.
SEGMENT_BYTES = 1_000_000
SEGMENT = "part int, inside bigint, doc_ids array<bigint>, sizes array<bigint>, n_tokens bigint, codes binary"


def pack(ids: np.ndarray) -> bytes:
    """Levels one after the other; each is its length, then chunks, bitmap and directory."""
    out, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        more = rest >> CHUNK_BITS
        go_on = more > 0
        bitmap = np.packbits(go_on, bitorder="little")
        counts = np.add.reduceat(go_on, np.arange(0, len(rest), DIRECTORY_BITS)) if len(rest) else np.zeros(0)
        directory = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        out += [np.array([len(rest)], "<u8").tobytes(), rest.astype(np.uint8).tobytes(), bitmap.tobytes(), directory.tobytes()]
        rest = more[go_on]
        if not len(rest):
            return b"".join(out)


class Codes:
    """Reads packed ids, one at a time or all."""

    def __init__(self, packed: bytes):
        self.levels, at = [], 0
        while at < len(packed):
            n = int(np.frombuffer(packed, "<u8", 1, at)[0])
            chunks = np.frombuffer(packed, np.uint8, n, at := at + 8)
            bitmap = np.frombuffer(packed, np.uint8, -(-n // 8), at := at + n)
            blocks = -(-n // DIRECTORY_BITS) + 1
            directory = np.frombuffer(packed, "<u4", blocks, at := at + len(bitmap))
            at += 4 * blocks
            self.levels.append((chunks, bitmap, directory))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        value = 0
        for depth, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * depth)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // DIRECTORY_BITS
            first = block * DIRECTORY_BITS // 8
            before = int.from_bytes(bitmap[first : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - block * DIRECTORY_BITS)) - 1)
            i = int(directory[block]) + before.bit_count()
        return value

    def all(self) -> np.ndarray:
        value = np.zeros(len(self), dtype=np.uint32)
        where = np.arange(len(self))
        for depth, (chunks, bitmap, _) in enumerate(self.levels):
            value[where] |= chunks.astype(np.uint32) << (CHUNK_BITS * depth)
            where = where[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return value


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary of byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """The library's merges for single pre-tokens, remembered, and the added tokens that texts are cut at first."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        letters, model = byte_alphabet(), tokenizer.model
        self.merges = PieceCache(lambda piece: [x.id for x in model.tokenize(piece.decode("latin-1").translate(letters))])
        added = json.loads(vocabulary).get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that depend on their surroundings are not supported")
        self.added = {t["content"].encode(): t["id"] for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")") if added else None

    def segments(self, texts: list[bytes], end_id: int) -> tuple[list[bytes], list[int], np.ndarray]:
        """The texts cut at added tokens; the id behind each segment, and the last segment of each text."""
        parts, behind, last = [], [], []
        for text in texts:
            own = self.cut.split(text) if self.cut else [text]
            parts += own[::2]
            behind += [self.added[x] for x in own[1::2]] + [end_id]
            last.append(len(parts) - 1)
        return parts, behind, np.array(last, dtype=np.int64)

    def ids(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and their number per text."""
        parts, behind, last = self.segments(texts, end_id)
        joined, edges, ends = pretokens.edges(parts)
        pieces = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(joined)])
        coded = pieces.dictionary_encode()
        # Each distinct pre-token of the chunk is looked up once; separators get an id of their own.
        known = list(map(self.merges.__getitem__, coded.dictionary.to_pylist()))
        closing = sorted(set(behind))
        flat = np.frombuffer(b"".join(known) + np.array(closing, "<i4").tobytes(), dtype="<i4")
        counts = np.concatenate([np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4, np.ones(len(closing), dtype=np.int64)])
        at = coded.indices.to_numpy().astype(np.int64)
        at[ends] = len(known) + np.searchsorted(closing, behind)
        first, size = np.cumsum(counts) - counts, counts[at]
        stops = np.cumsum(size)
        ids = flat[np.arange(stops[-1]) + np.repeat(first[at] - (stops - size), size)]
        return ids, np.diff(np.concatenate([[0], stops[ends[last]]]))


_held: dict[str, Encoder] = {}


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every text, each followed by ``end_id``, in ascending ``doc_id`` order."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())  # one fixed vocabulary file
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _held:
            _held[tokenizer_path] = Encoder(vocabulary.value)
        encoder, part = _held[tokenizer_path], TaskContext.get().partitionId()
        inside = 0  # ids of this part before the segment
        for batch, raw in text_chunks(batches, 1, SEGMENT_BYTES):
            ids, sizes = encoder.ids(raw, end_id)
            docs_here = pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), batch.column(0))
            yield pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([inside], pa.int64()), docs_here, list_array(sizes, np.array([len(sizes)]), pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([pack(ids)], pa.binary())],
                names=["part", "inside", "doc_ids", "sizes", "n_tokens", "codes"],
            )
            inside += len(ids)

    rows.mapInArrow(run, SEGMENT).write.mode("overwrite").option("compression", "none").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, ids`` of every document, decoded from the files."""
    segments = spark.read.schema(SEGMENT).parquet(folder)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], dtype=np.int64)
                ids = Codes(row["codes"]).all()
                starts = row["start"] + np.cumsum(sizes) - sizes
                yield pa.record_batch(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts), list_array(ids.astype(np.int64), sizes, pa.int64())],
                    names=["doc_id", "start", "ids"],
                )

    return _placed(segments, "doc_ids", "sizes", "codes").mapInArrow(run, "doc_id bigint, start bigint, ids array<bigint>")


def _placed(segments: DataFrame, *columns: str) -> DataFrame:
    """Segments with ``start``, the ids before them.

    Writers count inside their part, so only the totals of the parts are missing. They are one row per task that wrote,
    which bounds the running total over all parts and the broadcast; the codes are not shuffled.
    """
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", F.expr("sum(total) over (order by part) - total").alias("before"))
    placed = segments.join(F.broadcast(before), "part")
    return placed.select((F.col("before") + F.col("inside")).alias("start"), *columns)


def tokens_at(spark: SparkSession, folder: str, positions: DataFrame) -> DataFrame:
    """``position, id`` of the asked global positions; each is read from its segment by ranks alone."""
    segments = _placed(spark.read.schema(SEGMENT).parquet(folder), "n_tokens", "codes")
    asked = segments.join(
        positions.select(F.col("position").cast("long")),
        (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_tokens")),
    ).select("start", "codes", "position")
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row["position"], Codes(row["codes"])[row["position"] - row["start"]]) for row in batch.to_pylist()]
            yield pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["position", "id"])

    return asked.mapInArrow(run, "position bigint, id bigint")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    segments = spark.read.schema(SEGMENT).parquet(folder)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], dtype=np.int64)
                stops = np.cumsum(sizes)
                raw = memoryview(Codes(row["codes"]).all().astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((stops - sizes).tolist(), stops.tolist(), strict=True)]
                yield pa.record_batch(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + stops - sizes), pa.array(sizes), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    kinds = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return _placed(segments, "doc_ids", "sizes", "codes").mapInArrow(run, kinds)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents to files and returns position, length and checksum of each from the files."""
    import public_tokenizers

    folder = scratch(spark, "token-files")
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(spark, folder)

"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

``encode`` adds nothing to and drops nothing from the rows: one row out for each row in, with ``doc_id``, ``ids`` and
``offsets`` (byte position of each token in the UTF-8 text). ``decode`` puts the bytes of every token at its offset.

Defined cases: a null or empty text has empty arrays and decodes to no bytes; rows with equal ids or texts are
independent; an empty table gives an empty table; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantloom.llm import pretokens
from grantloom.llm.common import small_batches, table, text_chunks

#: Pre-tokens whose merges a worker remembers, and bytes of text it splits at once.
CACHE_PIECES, CHUNK_BYTES = 250_000, 1_000_000
#: Longer pre-tokens are merged but not remembered.
CACHED_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank is joined first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > CACHED_BYTES:
        return _merge_long(piece, ranks)
    none = len(ranks)
    get = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (low := min(pairs)) < none:
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[part] for part in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long pre-tokens, with a heap of pairs and linked neighbours."""
    n = len(piece)
    after, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ends[j] != end:
            continue  # one of the two has been joined with something else meanwhile
        alive[j] = False
        ends[i], after[i] = end, after[j]
        if after[j] < n:
            before[after[j]] = i
            k = after[j]
            if (r := ranks.get(piece[i : ends[k]])) is not None:
                heapq.heappush(heap, (r, i, ends[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
            heapq.heappush(heap, (r, h, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = after[i]
    return out


class PieceCache(dict):
    """Pre-token to its ids as little-endian 32-bit integers, in two generations: full, the older one is dropped."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of, self.older = ids_of, {}

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = np.array(self.ids_of(piece), dtype="<i4").tobytes()
        if len(piece) <= CACHED_BYTES:
            self.keep(piece, ids)
        return ids

    def keep(self, piece: bytes, ids: bytes) -> None:
        if len(self) >= CACHE_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids


_held: dict[str, tuple] = {}


def _encoder(path: str, ranks) -> tuple[PieceCache, np.ndarray]:
    """The worker's merges and the byte length of each id."""
    if path not in _held:
        known = ranks.value
        lengths = np.zeros(max(known.values()) + 1, dtype=np.int32)
        for token, rank in known.items():
            lengths[rank] = len(token)
        _held[path] = PieceCache(lambda piece: merge(piece, known)), lengths
    return _held[path]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def encode(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, offsets`` of every text by the ranks in the file."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))  # one fixed vocabulary file
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, lengths = _encoder(ranks_path, ranks)
        for batch, raw in text_chunks(batches, 1, CHUNK_BYTES):
            pieces, ends = pretokens.split(raw)
            parts, start = [], 0
            for end in ends.tolist():
                parts.append(b"".join(map(merges.__getitem__, pieces[start:end])))
                start = end + 1
            counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
            ids = np.frombuffer(b"".join(parts), dtype="<i4")
            sizes = lengths[ids].astype(np.int64)
            stop = np.cumsum(sizes)
            first = np.concatenate([[0], np.cumsum([len(x) for x in raw])[:-1]])
            offsets = (stop - sizes - np.repeat(first, counts)).astype(np.int32)
            yield pa.record_batch(
                [batch.column(0), list_array(ids, counts, pa.int32()), list_array(offsets, counts, pa.int32())],
                names=["doc_id", "ids", "offsets"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, offsets array<int>")


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """The rows of ``encode`` with ``decoded``: each token's bytes at its offset."""
    spark = tokens.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sorted((rank, token) for token, rank in ranks.value.items())
        flat = np.frombuffer(b"".join(token for _, token in known), dtype=np.uint8)
        lengths = np.zeros(known[-1][0] + 1, dtype=np.int64)
        lengths[[rank for rank, _ in known]] = [len(token) for _, token in known]
        begin = np.cumsum(lengths) - lengths
        for batch in batches:
            decoded = []
            for ids, offsets in zip(batch.column(1), batch.column(2), strict=True):
                ids = ids.values.to_numpy(zero_copy_only=False)
                sizes = lengths[ids]
                shift = begin[ids] - offsets.values.to_numpy(zero_copy_only=False)
                total = int(sizes.sum())
                decoded.append(flat[np.arange(total) + np.repeat(shift, sizes)].tobytes())
            yield pa.record_batch([*batch.columns, pa.array(decoded, pa.binary())], names=["doc_id", "ids", "offsets", "decoded"])

    return tokens.select("doc_id", "ids", "offsets").mapInArrow(
        run, f"doc_id {kind}, ids array<int>, offsets array<int>, decoded binary"
    )


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.concat_ws(" ", ids.cast("array<string>")), 256)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes, for every document."""
    path = default_ranks()
    rows = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

"""Language identification by compression: the language whose dictionary makes the text smallest.

For each language a zstandard dictionary holds raw text of a bounded sample of its documents. A text is compressed window
by window with every dictionary; the window lengths add up, and the smallest sum names the language. Only the letters
count: case, digits and marks are put aside first, for texts and dictionaries alike. Very short inputs would be stored
raw, so every window stands behind a fixed frame that all dictionaries end with. The result is rejected (``accepted`` false) when the runner-up is within a small share; the language itself is still given.

Defined cases: null texts and texts without a letter are ``und`` with score 0; equal sums go to the first language by
name; without any learned language everything is ``und``; repeated rows get equal results; an empty table gives an empty
table; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantloom.llm.common import small_batches, table, text_chunks
from grantloom.llm.samples import held_out, sample_texts

#: The fit: rows per language, bytes of a row at most, bytes of a dictionary.
FIT_ROWS, FIT_LONGEST, DICTIONARY_BYTES = 100, 65_536, 65_536
#: Bytes of a window, share of the best length that the runner-up must lie off, and compression level.
WINDOW_BYTES, NARROW, LEVEL = 1024, 0.01, 6
FRAME = bytes(range(0x80, 0xA0))
CHUNK_BYTES = 2_000_000


LETTERS = bytes(c if 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def letters(text: bytes) -> bytes:
    """Lower-case words of letters (and of what lies beyond ASCII), with one blank between them and at both ends."""
    return b" " + b" ".join(text.decode().lower().encode().translate(LETTERS).split()) + b" "


def dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """The same share of every sampled text, cut at ``size`` bytes in all."""
    share = max(256, size // max(1, len(texts)))
    return b"".join(letters(text)[:share] for text in texts)[:size] + FRAME


def compressor(raw: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(level, window_log=max(19, (len(raw) + 65_536).bit_length()), write_content_size=False, write_checksum=False)
    own.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=how)


def lengths(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    text = letters(text)
    windows = [FRAME + text[i : i + WINDOW_BYTES] for i in range(0, len(text), WINDOW_BYTES)]
    return np.array([sum(len(c.compress(w)) for w in windows) for c in compressors])


def classify(text: bytes | None, names: list[str], compressors: list[zstandard.ZstdCompressor]) -> tuple[str, float, bool]:
    """Language, confidence and whether the margin is wide enough."""
    if not text or not names or not any(map(str.isalpha, text.decode())):
        return "und", 0.0, False
    size = lengths(text, compressors)
    best = int(size.argmin())
    off = (size - size[best]) / max(1.0, 0.02 * size[best])
    margin = np.delete(off, best).min() * 0.02 if len(names) > 1 else 1.0
    return names[best], float(1 / np.exp(-off).sum()), bool(margin >= NARROW)


def learn(docs: DataFrame, folds: int = 5, fold: int = 0) -> dict[str, bytes]:
    """A dictionary for each language, from rows that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    found = sample_texts(docs, rows.select("doc_id", F.col("lang").alias("label")), FIT_ROWS, FIT_LONGEST)
    return {str(name): dictionary(found[name]) for name in sorted(found)}


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` of every text."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = list(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = [compressor(raw) for raw in dictionaries.values()]
        for batch, raw in text_chunks(batches, 1, CHUNK_BYTES):
            found = [classify(text, names, compressors) for text in raw]
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "lang_pred", "score", "accepted"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and confidence of every document."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "accepted")

"""Bounded, repeatable samples of labelled texts for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_crc(key: Column) -> Column:
    """CRC-32 of the id written as text; null for a null id."""
    return F.crc32(key.cast("string").cast("binary"))


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether the row is kept from learning; a null id is not held out."""
    return F.coalesce(F.pmod(text_crc(key), F.lit(folds)) == fold, F.lit(False))


def sample_texts(docs: DataFrame, classes: DataFrame, rows: int, longest: int) -> dict[object, list[bytes]]:
    """At most ``rows`` texts per class, of at most ``longest`` bytes, those with the least hash of the id.

    ``classes`` has ``doc_id`` and ``label``. The ids are chosen on these two narrow columns first; only the chosen texts
    are read and reach the driver, so classes x rows x longest bounds what it holds. Repeated rows of an id count once.
    """
    known = classes.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    # Only ids whose hash lies in the lowest part of its range are ranked: four times as many as are wanted, whatever
    # the size of the class.
    part = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    # One row per class is broadcast: the driver holds a fit of every class anyway.
    low = known.join(F.broadcast(sizes), "label").where(part * F.col("n") <= 4.0 * rows + 100)
    by = Window.partitionBy("label").orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 11), "doc_id")
    chosen = low.withColumn("place", F.row_number().over(by)).where(F.col("place") <= rows).select("doc_id", "label").collect()
    label = {r["doc_id"]: r["label"] for r in chosen}
    if not label:
        return {}
    texts = docs.where(F.col("doc_id").isin(list(label)) & (F.octet_length("text") <= longest))
    found: dict[object, list[bytes]] = {}
    for r in texts.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect():
        if r["text"]:
            found.setdefault(label[r["doc_id"]], []).append(r["text"].encode())
    return found

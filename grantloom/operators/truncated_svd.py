"""Truncated singular value decomposition of sparse rows by randomised block power iteration.

A block of ``dimensions`` plus some spare directions is multiplied with the rows and with their transpose again and again,
and made orthonormal in between, until it spans the leading right singular vectors. A pass reads the sparse rows
once; tasks add up their part of the product in slices of the vocabulary, and Spark adds up the slices. Nothing is as large
as the square of the vocabulary: the driver holds one block (vocabulary x directions).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directions beside the wanted ones, passes, and words of a slice.
SPARE, PASSES, SLICE = 20, 8, 64
#: Rows multiplied at once: their words and their part of the block stay in a processor's cache.
ROWS = 256


def cells(rows: DataFrame, vector: str) -> DataFrame:
    """Adds ``__at`` and ``__by``: positions and values of an MLlib vector column that are not zero."""
    pairs = F.filter(
        F.transform(vector_to_array(vector), lambda value, place: F.struct(place.alias("place"), value.alias("value"))),
        lambda cell: cell["value"] != 0,
    )
    held = rows.withColumn("__cells", F.explode(F.array(pairs)))  # a generator, so that the pairs are made once
    return held.withColumns({"__at": F.col("__cells.place"), "__by": F.col("__cells.value")}).drop("__cells")


def _flat(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All positions and values of some rows, and the row of each."""
    sizes = part["__at"].map(len).to_numpy()
    if not sizes.sum():
        return np.zeros(0, dtype=int), np.zeros(0), np.zeros(0, dtype=int)
    return np.concatenate(part["__at"].to_list()).astype(int), np.concatenate(part["__by"].to_list()), np.repeat(np.arange(len(part)), sizes)


def times(part: pd.DataFrame, block: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense block."""
    at, by, row = _flat(part)
    out = np.zeros((len(part), block.shape[1]))
    if len(at):
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[starts]] = np.add.reduceat(block[at] * by[:, None], starts, axis=0)
    return out


def _square(at: np.ndarray, by: np.ndarray, row: np.ndarray, block: np.ndarray, total: np.ndarray) -> None:
    """Adds transposed rows times rows times a dense block to ``total``, over the words that the rows have."""
    words, place = np.unique(at, return_inverse=True)
    dense = np.zeros((row[-1] + 1 if len(row) else 0, len(words)))
    np.add.at(dense, (row, place), by)
    total[words] += dense.T @ (dense @ block[words])


def _pass(sparse: DataFrame, block: np.ndarray) -> np.ndarray:
    """Transposed rows times rows times the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(block)
        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            at, by = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            row, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum([0, *sizes])
            for start in range(0, len(sizes), ROWS):
                own = slice(ends[start], ends[min(start + ROWS, len(sizes))])
                _square(at[own], by[own], row[own] - start, block, total)
        for start in range(0, len(total), SLICE):
            if total[start : start + SLICE].any():
                values = pa.array([total[start : start + SLICE].reshape(-1)], pa.list_(pa.float64()))
                yield pa.record_batch([pa.array([start // SLICE], pa.int32()), values], names=["slice", "values"])

    parts = sparse.select("__at", "__by").mapInArrow(run, "slice int, values array<double>")
    merged = parts.groupBy("slice").agg(vector_to_array(Summarizer.sum(array_to_vector("values"))).alias("values"))
    out = np.zeros_like(block)
    for row in merged.collect():  # one block
        start = row["slice"] * SLICE
        out[start : start + SLICE] = np.reshape(row["values"], (-1, block.shape[1]))
    return out


def directions(sparse: DataFrame, width: int, dimensions: int, passes: int = PASSES, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (``width`` x ``dimensions``) and squared singular values. ``sparse`` should be held."""
    block = np.linalg.qr(np.random.RandomState(seed).standard_normal((width, min(width, dimensions + SPARE))))[0]
    product = _pass(sparse, block)
    for _ in range(passes - 1):
        block = np.linalg.qr(product)[0]
        product = _pass(sparse, block)
    values, turn = np.linalg.eigh(block.T @ product)  # the rows' squares as the block sees them
    order = np.argsort(-values)[:dimensions]
    return block @ turn[:, order], np.maximum(values[order], 0.0)


def projected(sparse: DataFrame, basis: np.ndarray, output: str) -> DataFrame:
    """Adds the rows times the basis; one pass, no shuffle. Drops the cells."""

    @F.pandas_udf("array<double>")
    def project(at: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series(list(times(pd.DataFrame({"__at": at, "__by": by}), basis)))

    return sparse.withColumn(output, project("__at", "__by")).drop("__at", "__by")

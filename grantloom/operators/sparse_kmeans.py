"""K-means on sparse rows inside every group of a table at once.

Rows are positions and values in the vocabulary of their group, centres are dense. Distances come from norms and products
that touch only the words of a row, so they are never made dense. All groups share each pass, and a group that holds
a third of all rows is spread over all tasks: these add up a sum per (group, centre), and Spark adds up the sums.
The passes read blocks, the cells of many rows of one group in flat arrays, which are packed and stored once.

Starts are the first distinct rows of a group in digest order; distances are compared to nine digits and the first of
equal centres wins, so that short texts that are equally far from several centres go to the same one everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.operators.ranking import first_rows
from grantloom.session import settled

MOST_ROUNDS, START_ROWS, DIGITS = 30, 8, 9
#: Cells that a task holds before it writes its blocks, and cells that a pass works on at once.
HELD_CELLS, STEP_CELLS = 2_000_000, 100_000


def _nearest(sizes: np.ndarray, at: np.ndarray, by: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and the squared distance to it."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    norms = np.bincount(row, weights=by**2, minlength=len(sizes))
    products = [np.bincount(row, weights=by * own[at], minlength=len(sizes)) for own in centres]
    gaps = np.round(norms[:, None] - 2 * np.stack(products, axis=1) + (centres**2).sum(axis=1)[None, :], DIGITS)
    near = gaps.argmin(axis=1)
    return near, gaps[np.arange(len(near)), near]


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of a batch: places of its rows, their sizes, and the positions and values of all their cells."""
    group = batch.column("group").to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(batch.column("__at")).to_numpy(zero_copy_only=False).astype(np.int64)
    at, by = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("__at", "__by"))
    of_cell = np.repeat(group, sizes)
    for own in np.unique(group).tolist():
        rows, cells = np.flatnonzero(group == own), np.flatnonzero(of_cell == own)
        yield own, rows, sizes[rows], at[cells].astype(np.int64), by[cells]


BLOCK = "group int, sizes binary, at binary, by binary"


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of ``(group, __at, __by)``: row sizes, positions and values as 32-bit numbers and doubles, one group each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        cells = 0

        def flush() -> pa.RecordBatch:
            columns = [[np.concatenate(x).astype(t).tobytes() for x in column] for column, t in zip(zip(*(zip(*b) for b in held.values())), ("<i4", "<i4", "<f8"))]
            return pa.record_batch([pa.array(list(held), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["group", "sizes", "at", "by"])

        for batch in batches:
            for group, _, sizes, at, by in _grouped(batch):
                held.setdefault(group, []).append((sizes, at, by))
                cells += len(at) + len(sizes)
            if cells >= HELD_CELLS:
                yield flush()
                held.clear()
                cells = 0
        if held:
            yield flush()

    return rows.select("group", "__at", "__by").mapInArrow(run, BLOCK)


def _steps(sizes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Bounds of rows, and of their cells, of about ``STEP_CELLS`` cells and rows each."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends + np.arange(1, len(sizes) + 1), before + first + STEP_CELLS, side="right")))
        yield first, last, before, int(ends[last - 1])
        first = last


def _starts(rows: DataFrame, most: int) -> dict[int, np.ndarray]:
    """The first ``k`` distinct rows of each group; groups x ``most`` x START_ROWS rows are looked at."""
    held = rows.withColumn("__digest", F.md5(F.col("id").cast("string")))
    first = first_rows(held, ["group"], [F.col("__digest"), F.col("id")], START_ROWS * most).orderBy("group", "__digest", "id")
    found: dict[int, dict[tuple, tuple]] = {}
    facts: dict[int, tuple[int, int]] = {}
    for r in first.collect():
        found.setdefault(r["group"], {}).setdefault(tuple(zip(r["__at"], r["__by"])))
        facts[r["group"]] = (r["k"], r["width"])
    out = {}
    for group, seen in found.items():
        k, width = facts[group]
        out[group] = np.zeros((min(k, len(seen)), width))
        for centre, cells in zip(out[group], seen):
            for at, by in cells:
                centre[at] = by
    return out


def fit(rows: DataFrame, most: int, rounds: int = MOST_ROUNDS) -> dict[int, np.ndarray]:
    """Centres of each group over ``(id, group int, k int, width int, __at, __by)``; rows should be stored or held.

    Centres are groups x ``most`` x vocabulary numbers, which the caller bounds.
    """
    context, centres = rows.sparkSession.sparkContext, _starts(rows, most)
    blocks = settled(packed(rows))
    for _ in range(rounds):
        held = context.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            counts: dict[int, np.ndarray] = {}
            for batch in batches:
                for block in batch.to_pylist():
                    group, own = block["group"], held.value[block["group"]]
                    k, width = own.shape
                    if group not in sums:
                        sums[group], counts[group] = np.zeros(width * k), np.zeros(k)
                    every = [np.frombuffer(block[c], t) for c, t in (("sizes", "<i4"), ("at", "<i4"), ("by", "<f8"))]
                    for first, last, start, end in _steps(every[0]):
                        sizes, at, by = every[0][first:last], every[1][start:end].astype(np.int64), every[2][start:end]
                        near, _ = _nearest(sizes, at, by, own)
                        sums[group] += np.bincount(np.repeat(near, sizes) * width + at, weights=by, minlength=width * k)
                        counts[group] += np.bincount(near, minlength=k)
            for group, total in sums.items():
                found = np.flatnonzero(counts[group])
                total = total.reshape(len(counts[group]), -1)[found]
                columns = [
                    pa.array(np.full(len(found), group), pa.int32()), pa.array(found, pa.int32()), pa.array(counts[group][found]),
                    pa.array(list(total), pa.list_(pa.float64())),
                ]
                yield pa.record_batch(columns, names=["group", "centre", "n", "sum"])

        parts = blocks.mapInArrow(run, "group int, centre int, n double, sum array<double>")
        merged = parts.groupBy("group", "centre").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("sum"))).alias("sum"))
        after = {group: own.copy() for group, own in centres.items()}
        for r in merged.collect():  # one set of centres
            after[r["group"]][r["centre"]] = np.array(r["sum"]) / r["n"]
        still = all(np.allclose(after[g], centres[g], rtol=0, atol=1e-12) for g in centres)
        centres = after
        held.destroy()
        if still:
            break
    return centres


def assign(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``id, group, centre, gap`` of every row; one pass, no shuffle."""
    held = rows.sparkSession.sparkContext.broadcast(centres)
    kind = rows.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, gaps = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch))
            for group, own, sizes, at, by in _grouped(batch):
                near[own], gaps[own] = _nearest(sizes, at, by, held.value[group])
            yield pa.record_batch([batch.column("id"), batch.column("group"), pa.array(near), pa.array(gaps)], names=["id", "group", "centre", "gap"])

    return rows.select("id", "group", "__at", "__by").mapInArrow(place, f"id {kind}, group int, centre int, gap double")

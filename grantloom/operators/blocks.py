"""Rows of numbers packed into blocks, and exact k-means rounds over them.

A round of k-means that gets its rows one array at a time spends its time on handing them over. Here the rows are packed
once: a block is a matrix of rows of one group, in leaves of neighbouring rows whose number, sum, squares, middle and
radius are noted. By the triangle inequality only centres within the least distance to the middle plus twice the
radius can be nearest to a row of the leaf: a leaf with one such centre is added as a whole, others compare their rows with
these centres only. The result is that of comparing every row with every centre.

Blocks are held by the executors. A round runs as few tasks as there are cores, Spark adds up the sums of each group, and
one set of centres reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

#: Rows of a leaf, bytes of a block and of what a task holds while it packs; coordinates up to which leaves are formed.
LEAF, BLOCK_BYTES, HELD_BYTES, MOST_LEAF_WIDTH = 512, 1 << 21, 1 << 24, 8
#: Rows compared at once; tasks of a round for each core.
ROWS, TASKS_PER_CORE = 4096, 1


def closest(matrix: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row, the first of equal ones, and the squared distance to it."""
    gaps = (matrix**2).sum(axis=1)[:, None] - 2 * matrix @ centres.T + (centres**2).sum(axis=1)[None, :]
    best = gaps.argmin(axis=1)
    return best, np.maximum(gaps[np.arange(len(best)), best], 0.0)


def matrix_of(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long arrays as a matrix."""
    lengths = column.value_lengths().unique().to_pylist()
    if len(lengths) > 1 or None in lengths:
        raise ValueError(f"vectors of different lengths: {lengths}")
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), lengths[0] if lengths else 0)


def _neighbouring(matrix: np.ndarray) -> np.ndarray:
    """An order in which every ``LEAF`` rows lie close together: halves along the widest coordinate, again and again."""
    order, open_ = np.arange(len(matrix)), [(0, len(matrix))]
    while open_:
        low, high = open_.pop()
        if high - low <= LEAF:
            continue
        own = matrix[order[low:high]]
        half = -(-(high - low) // LEAF) // 2 * LEAF
        order[low:high] = order[low:high][np.argpartition(own[:, np.ptp(own, axis=0).argmax()], half)]
        open_ += [(low, low + half), (low + half, high)]
    return order


class Block:
    """Rows of a group and the facts of their leaves (none for wide rows)."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.sizes = matrix, None
        if matrix.shape[1] <= MOST_LEAF_WIDTH:
            starts = np.arange(0, len(matrix), LEAF)
            self.sizes = np.diff([*starts, len(matrix)])
            self.sums = np.add.reduceat(matrix, starts)
            self.squares = np.add.reduceat((matrix**2).sum(axis=1), starts)
            self.middles = self.sums / self.sizes[:, None]
            self.radius = np.sqrt(np.maximum.reduceat(((matrix - np.repeat(self.middles, self.sizes, axis=0)) ** 2).sum(axis=1), starts))

    def add(self, centres: np.ndarray, counts: np.ndarray, costs: np.ndarray, sums: np.ndarray) -> None:
        """Adds number, squared distance and sum of the rows nearest to each centre."""
        if self.sizes is None:
            return self._compare(self.matrix, centres, np.arange(len(centres)), counts, costs, sums)
        apart = np.sqrt(((self.middles[:, None, :] - centres[None]) ** 2).sum(axis=2))
        reach = apart.min(axis=1) + 2 * self.radius
        near = apart <= (reach * (1 + 1e-9) + 1e-9)[:, None]
        if near.mean() > 0.5 and len(centres) > 2:
            return self._compare(self.matrix, centres, np.arange(len(centres)), counts, costs, sums)
        alone = near.sum(axis=1) == 1
        own = near[alone].argmax(axis=1)
        np.add.at(counts, own, self.sizes[alone])
        np.add.at(sums, own, self.sums[alone])
        whole = self.squares[alone] - 2 * (self.sums[alone] * centres[own]).sum(axis=1) + self.sizes[alone] * (centres[own] ** 2).sum(axis=1)
        np.add.at(costs, own, np.maximum(whole, 0.0))
        for leaf in np.flatnonzero(~alone):
            self._compare(self.matrix[leaf * LEAF : (leaf + 1) * LEAF], centres, np.flatnonzero(near[leaf]), counts, costs, sums)

    @staticmethod
    def _compare(matrix: np.ndarray, centres: np.ndarray, among: np.ndarray, counts: np.ndarray, costs: np.ndarray, sums: np.ndarray) -> None:
        chosen = centres[among]
        for start in range(0, len(matrix), ROWS):
            part = matrix[start : start + ROWS]
            best, gaps = closest(part, chosen)
            counts[among] += np.bincount(best, minlength=len(among))
            costs[among] += np.bincount(best, weights=gaps, minlength=len(among))
            if part.shape[1] <= MOST_LEAF_WIDTH:
                for place in range(part.shape[1]):
                    sums[among, place] += np.bincount(best, weights=part[:, place], minlength=len(among))
            else:
                sums[among] += (best == np.arange(len(among))[:, None]).astype(np.float64) @ part


def packed(rows: DataFrame) -> RDD:
    """Blocks ``(group, Block)`` of ``(group int, vector array<double>)``, held by the executors until ``unpersist``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for group, parts in held.items():
                matrix = np.concatenate(parts)
                if matrix.shape[1] <= MOST_LEAF_WIDTH:
                    matrix = matrix[_neighbouring(matrix)]
                step = max(1, BLOCK_BYTES // (8 * LEAF * max(matrix.shape[1], 1))) * LEAF
                for start in range(0, len(matrix), step):
                    block = matrix[start : start + step]
                    cells = (pa.array([group], pa.int32()), pa.array([matrix.shape[1]], pa.int32()), pa.array([block.tobytes()], pa.binary()))
                    yield pa.record_batch(list(cells), names=["group", "width", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            groups, matrix = batch.column(0).to_numpy(zero_copy_only=False), matrix_of(batch.column(1))
            order = np.argsort(groups, kind="stable")
            met, starts = np.unique(groups[order], return_index=True)
            for group, own in zip(met.tolist(), np.split(order, starts[1:]), strict=True):
                held.setdefault(group, []).append(matrix[own])
            size += matrix.nbytes
            if size >= HELD_BYTES:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    def opened(row) -> tuple[int, Block]:
        return row["group"], Block(np.frombuffer(row["data"], dtype=np.float64).reshape(-1, row["width"]))

    found = rows.select("group", "vector").mapInArrow(pack, "group int, width int, data binary").rdd
    if found.getNumPartitions() < found.context.defaultParallelism:  # few large partitions would leave cores idle
        found = found.keyBy(lambda row: zlib.crc32(row["data"][:64])).partitionBy(found.context.defaultParallelism).values()
    return found.map(opened).persist(StorageLevel.MEMORY_AND_DISK)


def step(blocks: RDD, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Number, squared distance and sum of the rows nearest to each centre, by group; one pass."""
    cores = blocks.context.defaultParallelism

    def run(own: Iterator[tuple[int, Block]]) -> Iterator[tuple[int, tuple]]:
        held: dict[int, tuple] = {}
        for group, block in own:
            if group not in held:
                found = centres[group]
                held[group] = np.zeros(len(found)), np.zeros(len(found)), np.zeros_like(found)
            block.add(centres[group], *held[group])
        yield from held.items()

    parts = blocks.coalesce(min(blocks.getNumPartitions(), TASKS_PER_CORE * cores)).mapPartitions(run)
    added = parts.reduceByKey(lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)), min(len(centres), cores) or 1)
    return dict(added.collect())  # one set of centres

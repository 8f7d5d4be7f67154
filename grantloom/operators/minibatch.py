"""Mini-batch k-means: centres learn from one hashed batch at a time.

The rows are dealt into batches by a digest of their id and written once, a folder per batch or window of small batches,
so a step reads its batches alone. The rows of a batch go to their nearest centres; a centre moves towards the mean of its rows by the share that
they have in all rows it has seen, so early batches move it far and late ones little. After a batch, centres that have
seen far fewer rows than the busiest one are starved: they are put on rows of the batch that lie farthest from their
centres and start again with the least count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.operators.grouped_kmeans import closest, plus_plus
from grantloom.session import scratch_folder

#: Rows of a batch, rows per centre that a start is chosen from, and share of the busiest centre's rows that starves.
BATCH_ROWS, START_ROWS, STARVED = 1_000_000, 32, 0.01
#: Rows of a window: smaller batches are read in windows, a pass for each window instead of each batch.
WINDOW_ROWS = 8192
#: Starts that are tried on these rows, and rounds that each gets.
STARTS, START_ROUNDS = 8, 10


def batch_of(key: str, batches: int):
    """Number of the batch by the first 32 bits of the digest of the key."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(batches))


def deal(rows: DataFrame, batches: int, total: int) -> tuple[str, int]:
    """Writes ``(id, vector)`` as one folder per window of batches, and gives the batches of a window.

    A window has as many whole batches as ``WINDOW_ROWS`` hold, one at least; a batch above that becomes several files.
    """
    path, several = scratch_folder(rows.sparkSession, "batches"), max(1, WINDOW_ROWS * batches // max(total, 1))
    files = 8 if several == 1 else 1
    number = F.col("batch")
    rows.select("id", "vector").withColumn("batch", batch_of("id", batches)).withColumn("window", F.floor(number / several)).repartition(
        "window", F.pmod(F.xxhash64("id"), F.lit(files))
    ).write.partitionBy("window").parquet(path)
    return path, several


def _sums(parts: Iterator[pd.DataFrame], centres: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Rows, sums and costs per centre of some rows, and the ``far`` of them that lie farthest from their centres."""
    sums, counts, cost = np.zeros_like(centres), np.zeros(len(centres)), np.zeros(len(centres))
    tops: list[tuple[float, tuple]] = []
    for part in parts:
        if len(part):
            matrix = np.stack(part["vector"].to_numpy()).astype(np.float64)
            near, gaps = closest(matrix, centres)
            np.add.at(sums, near, matrix)
            np.add.at(counts, near, 1)
            np.add.at(cost, near, gaps)
            order = np.lexsort((part["id"].to_numpy(), -gaps))[:far]
            tops = sorted([*tops, *((float(-gaps[i]), tuple(matrix[i])) for i in order)])[:far]
    return counts, sums, cost, tops


def _step(batch: DataFrame, centres: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and sums per centre, and the ``far`` rows that lie farthest from their centres."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums, cost, tops = _sums(parts, centres, far)
        met = np.flatnonzero(counts)
        yield pd.DataFrame({
            "centre": np.concatenate([met, np.full(len(tops), -1)]).astype("int32"),
            "n": np.concatenate([counts[met], np.zeros(len(tops))]),
            "cost": np.concatenate([cost[met], [-gap for gap, _ in tops]]),
            "vector": [*sums[met], *(np.array(v) for _, v in tops)],
        })

    counts, sums, tops = np.zeros(len(centres)), np.zeros_like(centres), []
    parts = batch.mapInPandas(partial, "centre int, n double, cost double, vector array<double>").persist()
    try:
        added = vector_to_array(Summarizer.sum(array_to_vector("vector"))).alias("vector")
        for row in parts.where("centre >= 0").groupBy("centre").agg(F.sum("n").alias("n"), added).collect():
            counts[row["centre"]], sums[row["centre"]] = row["n"], row["vector"]
        for row in parts.where("centre < 0").orderBy(F.desc("cost"), "vector").limit(far).collect():
            tops.append(row["vector"])
    finally:
        parts.unpersist()
    return counts, sums, np.array(tops)


def _learn(centres: np.ndarray, seen: np.ndarray, counts: np.ndarray, sums: np.ndarray, tops: np.ndarray, last: bool) -> None:
    """Moves the centres by what a batch has found, and starved ones to its farthest rows unless it is the last."""
    seen += counts
    met = counts > 0
    centres[met] += (sums[met] / counts[met, None] - centres[met]) * (counts[met] / seen[met])[:, None]
    starved = np.flatnonzero(seen < STARVED * seen.max())
    if len(starved) and not last:
        least = seen[seen >= STARVED * seen.max()].min()
        for place, vector in zip(starved, tops):
            centres[place], seen[place] = vector, least


def _window(rows: DataFrame, centres: np.ndarray, seen: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Centres, rows seen and rows of each batch after the batches of one window, one after the other.

    Each batch needs the centres of the one before it, so a window of small batches is one task; ``WINDOW_ROWS`` bounds it.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found, known, read = centres.copy(), seen.copy(), []
        for number, batch in part.groupby("batch"):
            counts, sums, _, tops = _sums(iter([batch]), found, len(found))
            read.append(int(counts.sum()))
            _learn(found, known, counts, sums, np.array([v for _, v in tops]), number == last)
        return pd.DataFrame({"centres": [found.reshape(-1)], "seen": [known], "read": [read]})

    out = rows.groupBy("window").applyInPandas(run, "centres array<double>, seen array<double>, read array<bigint>").first()
    return np.reshape(out["centres"], centres.shape), np.array(out["seen"]), out["read"]


def start(matrix: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The best of some starts on a bounded sample, each after a few rounds; copies in the sample count once."""
    matrix, best = np.unique(matrix, axis=0), None
    for number in range(STARTS):
        centres = plus_plus(matrix, k, seed + number)
        for _ in range(START_ROUNDS):
            near, _ = closest(matrix, centres)
            centres = np.array([matrix[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        cost = closest(matrix, centres)[1].sum()
        if best is None or cost < best[0]:
            best = (cost, centres)
    return best[1]


def fit(rows: DataFrame, k: int, batch_rows: int = BATCH_ROWS, seed: int = 42) -> tuple[np.ndarray, list[int]]:
    """Centres after each batch has been read once, and the rows of each batch in the order they were read."""
    spark, total = rows.sparkSession, rows.count()
    if not total:
        return np.zeros((0, 0)), []
    batches = max(1, -(-total // batch_rows))
    path, several = deal(rows, batches, total)
    kind = rows.schema["id"].dataType
    held = spark.read.parquet(path).withColumn("id", F.col("id").cast(kind))
    ends = held.agg(F.min("batch").alias("first"), F.max("batch").alias("last")).first()
    windows = sorted(r["window"] for r in held.select("window").distinct().collect())
    first = held.where((F.col("window") == windows[0]) & (F.col("batch") == ends["first"]))
    first = first.orderBy(F.md5(F.col("id").cast("string")), "id").limit(START_ROWS * k)
    centres = start(np.stack(first.toPandas()["vector"].to_numpy()).astype(np.float64), k, seed)
    seen, read = np.zeros(len(centres)), []
    for number in windows:
        own = held.where(F.col("window") == number)
        if several > 1:
            centres, seen, rows_read = _window(own, centres, seen, ends["last"])
            read += rows_read
        else:
            counts, sums, tops = _step(own.select("id", "vector"), centres, len(centres))
            read.append(int(counts.sum()))
            _learn(centres, seen, counts, sums, tops, number == windows[-1])
    return centres, read


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``id, cluster, gap``: nearest centre and squared distance of every row; one pass, no shuffle."""
    kind = rows.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near, gaps = closest(np.stack(batch["vector"].to_numpy()).astype(np.float64), centres)
                yield pd.DataFrame({"id": batch["id"], "cluster": near.astype("int32"), "gap": gaps})

    return rows.select("id", "vector").mapInPandas(place, f"id {kind}, cluster int, gap double")

"""Many k-means fits over one table in the same passes.

A candidate is a number of clusters and a scale per coordinate. Standardising, block weights and scales are folded
into the distance, so all candidates read the same stored vectors: a pass compares each row with the centres of every
candidate and adds up its sums; only sums (candidates x clusters x coordinates) reach the driver. The number of passes is
that of the slowest candidate, whatever the number of candidates. Scores of all candidates take two more passes.

Starts are the first distinct vectors in digest order, rounds end when no centre moves, and a centre without rows stays:
a fit has no random part and can be repeated by any other engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds of a fit that does not settle before, and rows looked at for each centre of a start.
MOST_ROUNDS, START_ROWS = 30, 4


@dataclass
class Candidate:
    """``scale`` multiplies the standardised coordinates; ``centres`` and ``sizes`` are those of the last pass."""

    name: tuple
    k: int
    scale: np.ndarray
    centres: np.ndarray | None = None
    sizes: np.ndarray | None = None


def digest(key: str = "id"):
    return F.md5(F.col(key).cast("string"))


def _joined(one: tuple | None, other: tuple) -> tuple:
    """Number, mean and squared deviations of two parts together."""
    if one is None:
        return other
    gap, n = other[1] - one[1], one[0] + other[0]
    return n, one[1] + gap * (other[0] / n), one[2] + other[2] + gap**2 * (one[0] * other[0] / n)


def moments(rows: DataFrame, vector: str = "vector") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, (population) deviation with one for constant coordinates, and number of rows, in one pass."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if len(batch):
                matrix = np.stack(batch[vector].to_numpy()).astype(np.float64)
                mean = matrix.mean(axis=0)
                held = _joined(held, (len(matrix), mean, ((matrix - mean) ** 2).sum(axis=0)))
        if held:
            yield pd.DataFrame({"n": [held[0]], "mean": [held[1]], "rest": [held[2]]})

    held = None
    for part in rows.select(vector).mapInPandas(sums, "n bigint, mean array<double>, rest array<double>").collect():
        held = _joined(held, (part["n"], np.array(part["mean"]), np.array(part["rest"])))  # a row per task
    n, mean, rest = held or (0, np.zeros(0), np.zeros(0))
    deviation = np.sqrt(rest / max(n, 1))
    return mean, np.where(deviation > 0, deviation, 1.0), n


def _start(rows: DataFrame, candidates: list[Candidate], shape) -> None:
    most = max(c.k for c in candidates)
    first = rows.orderBy(digest(), "id").limit(START_ROWS * most).select("vector").collect()
    seen: dict[tuple, None] = {}
    for row in first:
        seen.setdefault(tuple(row["vector"]))
    vectors = shape(np.array(list(seen), dtype=np.float64))
    for c in candidates:
        c.centres, c.sizes = (vectors * c.scale)[: c.k], np.zeros(min(c.k, len(vectors)))


def gaps(matrix: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    return np.maximum((matrix**2).sum(axis=1)[:, None] - 2 * matrix @ centres.T + (centres**2).sum(axis=1)[None, :], 0.0)


def _totals(rows: DataFrame, columns: list[str], kind: str, of_batch) -> dict[tuple, list]:
    """Sums of what ``of_batch`` gives for (candidate, cluster), added up in the tasks first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for batch in batches:
            if len(batch):
                for key, values in of_batch(batch):
                    held[key] = [a + b for a, b in zip(held[key], values)] if key in held else values
        if held:
            yield pd.DataFrame(
                [(*key, *values) for key, values in held.items()],
                columns=["candidate", "cluster", *[f"v{i}" for i in range(len(next(iter(held.values()))))]],
            )

    names = [f"v{i}" for i in range(len(kind.split()))]
    parts = rows.select(*columns).mapInPandas(run, "candidate int, cluster int, " + ", ".join(f"{n} {t}" for n, t in zip(names, kind.split())))
    added = [
        vector_to_array(Summarizer.sum(array_to_vector(n))).alias(n) if t.startswith("array") else F.sum(n).alias(n)
        for n, t in zip(names, kind.split())
    ]
    found = {}
    for part in parts.groupBy("candidate", "cluster").agg(*added).collect():  # candidates x clusters rows
        found[part["candidate"], part["cluster"]] = [np.array(part[n]) if isinstance(part[n], list) else part[n] for n in names]
    return found


def fit(rows: DataFrame, candidates: list[Candidate], mean: np.ndarray, deviation: np.ndarray, rounds: int = MOST_ROUNDS) -> int:
    """Centres of all candidates over ``(id, vector)``; returns the number of passes. Rows should be stored or held."""
    shape = lambda m: (m - mean) / deviation
    _start(rows, candidates, shape)
    open_ = list(range(len(candidates)))
    for number in range(1, rounds + 1):
        now = {i: (candidates[i].scale, candidates[i].centres) for i in open_}

        def of_batch(batch: pd.DataFrame, now=now):
            matrix = shape(np.stack(batch["vector"].to_numpy()).astype(np.float64))
            for i, (scale, centres) in now.items():
                scaled = matrix * scale
                near = gaps(scaled, centres).argmin(axis=1)
                order = np.argsort(near, kind="stable")
                met, starts, sizes = np.unique(near[order], return_index=True, return_counts=True)
                sums = np.add.reduceat(scaled[order], starts, axis=0)
                for cluster, size, total in zip(met.tolist(), sizes.tolist(), sums, strict=True):
                    yield (i, cluster), [size, total]

        found, moving = _totals(rows, ["vector"], "bigint array<double>", of_batch), []
        for i in open_:
            before = candidates[i].centres
            after = before.copy()
            for cluster in range(len(before)):
                if (i, cluster) in found:
                    n, total = found[i, cluster]
                    after[cluster] = total / n
            candidates[i].centres = after
            if not np.allclose(after, before, rtol=0, atol=1e-12):
                moving.append(i)
        open_ = moving
        if not open_:
            return number
    return rounds


def labelled(rows: DataFrame, candidate: Candidate, mean: np.ndarray, deviation: np.ndarray) -> DataFrame:
    """``id, cluster, gap``: nearest centre and squared distance of every row."""
    kind = rows.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = gaps((np.stack(batch["vector"].to_numpy()) - mean) / deviation * candidate.scale, candidate.centres)
                near = found.argmin(axis=1)
                yield pd.DataFrame({"id": batch["id"], "cluster": near.astype("int32"), "gap": found[np.arange(len(near)), near]})

    return rows.select("id", "vector").mapInPandas(place, f"id {kind}, cluster int, gap double")


def scores(rows: DataFrame, candidates: list[Candidate], mean: np.ndarray, deviation: np.ndarray, plain: int | None = None) -> list[dict]:
    """Per candidate: silhouette (squared distances), Calinski-Harabasz, Davies-Bouldin and sizes, in two passes.

    With ``plain``, also the cosine silhouette over that many first coordinates and, if the rows have ``code``, the mean
    share of the most frequent code of a cluster. Silhouettes follow from cluster sums, so no two rows are compared.
    """
    shape = lambda m: (m - mean) / deviation
    held = [(c.scale, c.centres) for c in candidates]
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    width = plain or 1  # vector sums need a coordinate

    def first(batch: pd.DataFrame):
        matrix = shape(np.stack(batch["vector"].to_numpy()).astype(np.float64))
        for i, (scale, centres) in enumerate(held):
            scaled = matrix * scale
            near = gaps(scaled, centres).argmin(axis=1)
            for cluster in np.unique(near):
                own = near == cluster
                yield (i, int(cluster)), [int(own.sum()), scaled[own].sum(axis=0), float((scaled[own] ** 2).sum()), unit(matrix[own, :width]).sum(axis=0)]

    sums = _totals(rows, ["vector"], "bigint array<double> double array<double>", first)
    keys = [sorted(cluster for j, cluster in sums if j == i) for i in range(len(candidates))]
    n = [np.array([sums[i, c][0] for c in keys[i]], dtype=float) for i in range(len(candidates))]
    total = [np.stack([sums[i, c][1] for c in keys[i]]) for i in range(len(candidates))]
    squares = [np.array([sums[i, c][2] for c in keys[i]]) for i in range(len(candidates))]
    units = [np.stack([sums[i, c][3] for c in keys[i]]) for i in range(len(candidates))]
    tables = list(zip(held, keys, n, total, squares, units))

    def against(mean_gaps: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Silhouettes from the mean distance to each cluster; a cluster of one row has zero."""
        place, own = np.arange(len(at)), sizes[at]
        inner = mean_gaps[place, at] * own / np.maximum(own - 1, 1)
        others = mean_gaps.copy()
        others[place, at] = np.inf
        outer = others.min(axis=1)
        high = np.maximum(inner, outer)
        ok = (own > 1) & (high > 0) & np.isfinite(outer)
        return np.where(ok, (outer - inner) / np.where(ok, high, 1.0), 0.0)

    def second(batch: pd.DataFrame):
        matrix = shape(np.stack(batch["vector"].to_numpy()).astype(np.float64))
        for i, ((scale, centres), clusters, sizes, sum_, square, unit_sum) in enumerate(tables):
            scaled = matrix * scale
            at = np.searchsorted(clusters, gaps(scaled, centres).argmin(axis=1))
            to_means = (scaled**2).sum(axis=1)[:, None] + square / sizes - 2 * scaled @ (sum_ / sizes[:, None]).T
            combined = against(to_means, at, sizes)
            semantic = against(1 - unit(matrix[:, :width]) @ (unit_sum / sizes[:, None]).T, at, sizes) if plain else np.zeros(len(at))
            spread = ((scaled - (sum_ / sizes[:, None])[at]) ** 2).sum(axis=1)
            for place in np.unique(at):
                own = at == place
                yield (i, int(place)), [float(combined[own].sum()), float(semantic[own].sum()), float(spread[own].sum()), float(np.sqrt(spread[own]).sum())]

    parts = _totals(rows, ["vector"], "double double double double", second)
    purity = _purity(rows, candidates, shape) if "code" in rows.columns else None
    out = []
    for i, c in enumerate(candidates):
        own = np.array([parts[i, p] for p in range(len(keys[i]))])
        rows_, means = n[i].sum(), total[i] / n[i][:, None]
        middle, within, scatter = total[i].sum(axis=0) / rows_, own[:, 2].sum(), own[:, 3] / n[i]
        k = len(n[i])
        between = (n[i] * ((means - middle) ** 2).sum(axis=1)).sum()
        apart = np.sqrt(gaps(means, means))
        np.fill_diagonal(apart, np.inf)
        out.append({
            "name": c.name, "clusters": k, "silhouette": float(own[:, 0].sum() / rows_), "semantic": float(own[:, 1].sum() / rows_),
            "calinski_harabasz": float((between / (k - 1)) / (within / (rows_ - k))) if k > 1 and within > 0 and rows_ > k else None,
            "davies_bouldin": float(((scatter[:, None] + scatter[None, :]) / apart).max(axis=1).mean()) if k > 1 else None,
            "low": int(n[i].min()), "high": int(n[i].max()), "mean": float(rows_ / k), "cost": float(within),
            "purity": purity[i] if purity else None,
        })
    return out


def _purity(rows: DataFrame, candidates: list[Candidate], shape) -> list[float]:
    """Mean share of the most frequent code in the clusters of each candidate."""
    held = [(c.scale, c.centres) for c in candidates]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                matrix = shape(np.stack(batch["vector"].to_numpy()).astype(np.float64))
                for i, (scale, centres) in enumerate(held):
                    near = gaps(matrix * scale, centres).argmin(axis=1)
                    part = pd.DataFrame({"candidate": i, "cluster": near, "code": batch["code"]})
                    yield part.groupby(["candidate", "cluster", "code"], dropna=False).size().reset_index(name="n")

    counts = rows.select("vector", "code").mapInPandas(place, "candidate int, cluster int, code string, n bigint")
    counts = counts.groupBy("candidate", "cluster", "code").agg(F.sum("n").alias("n"))
    shares = counts.groupBy("candidate", "cluster").agg((F.max("n") / F.sum("n")).alias("share"))
    found = {r["candidate"]: r["share"] for r in shares.groupBy("candidate").agg(F.avg("share").alias("share")).collect()}
    return [found[i] for i in range(len(candidates))]


def search(rows: DataFrame, candidates: list[Candidate], standardised: bool, plain: int | None = None, rounds: int = MOST_ROUNDS) -> list[dict]:
    """Fits and scores all candidates over ``(id, vector)``.

    The rows are dealt to all cores: a pass costs far more than its bytes, by which few partitions would do.
    """
    held = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        mean, deviation, _ = moments(held)
        if not standardised:
            mean, deviation = np.zeros_like(mean), np.ones_like(deviation)
        fit(held, candidates, mean, deviation, rounds)
        return scores(held, candidates, mean, deviation, plain)
    finally:
        held.unpersist()

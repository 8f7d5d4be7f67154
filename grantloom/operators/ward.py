"""Ward hierarchies over mergeable cluster features.

A cluster feature is the number of rows and the mean of a cluster; two of them merge exactly, and Ward's criterion needs
nothing else. Distinct vectors are features of their own. While there are more of them than leaves are wanted, they are
dealt into buckets by a hash, and each bucket merges its features by Ward's criterion to a fraction; buckets are bounded
and independent, and rounds go on until at most ``leaves`` features are left. The hierarchy over these leaves is built by
nearest-neighbour chains, which finds the same merges as a search over all pairs. With no more distinct vectors than
leaves the hierarchy is the exact one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantloom.operators.grouped_kmeans import closest
from grantloom.session import settled

#: Leaves of the hierarchy, and features of a bucket for each one that it keeps.
LEAVES, FACTOR = 1000, 4


def chain_merges(sizes: np.ndarray, means: np.ndarray) -> np.ndarray:
    """All merges ``(one, other, height)`` in ascending height; a merged cluster goes on under the name ``other``.

    The height is ``sqrt(2 ab / (a + b))`` times the distance of the means: for two rows their distance.
    """
    names = np.arange(len(sizes))
    sizes, means = sizes.astype(np.float64).copy(), means.astype(np.float64).copy()
    alive = np.ones(len(sizes), dtype=bool)
    chain: list[int] = []
    merges = []
    for left in range(len(sizes), 1, -1):
        if left < len(sizes) // 2:  # merged places are not compared any more
            at = np.full(len(alive), -1)
            at[alive] = np.arange(left)
            chain = [int(at[place]) for place in chain]
            names, sizes, means, alive = names[alive], sizes[alive], means[alive], np.ones(left, dtype=bool)
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            now = chain[-1]
            gaps = ((means - means[now]) ** 2).sum(axis=1) * (sizes * sizes[now] / (sizes + sizes[now]))
            gaps[~alive] = np.inf
            gaps[now] = np.inf
            near = int(gaps.argmin())
            if len(chain) > 1 and gaps[chain[-2]] <= gaps[near]:
                break
            chain.append(near)
        one, other = chain.pop(), chain.pop()
        merges.append((names[one], names[other], math.sqrt(2 * gaps[other])))
        total = sizes[one] + sizes[other]
        means[other] += (means[one] - means[other]) * (sizes[one] / total)
        sizes[other], alive[one] = total, False
    found = np.array(merges, dtype=[("one", "i8"), ("other", "i8"), ("height", "f8")])
    return found[np.argsort(found["height"], kind="stable")]


def cut(merges: np.ndarray, leaves: int, clusters: int) -> np.ndarray:
    """Cluster of every leaf after the lowest merges, numbered by the first leaf of each."""
    root = list(range(leaves))

    def top(place: int) -> int:
        while root[place] != place:
            root[place] = root[root[place]]
            place = root[place]
        return place

    for one, other, _ in merges[: max(0, leaves - clusters)]:
        a, b = top(int(one)), top(int(other))
        root[max(a, b)] = min(a, b)
    tops = [top(place) for place in range(leaves)]
    number = {place: i for i, place in enumerate(sorted(set(tops)))}
    return np.array([number[place] for place in tops], dtype=np.int64)


def _merged_to(wanted: int):
    """Merges the features of a bucket to ``wanted`` ones."""

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vector", key=lambda column: column.map(tuple))
        means, sizes = np.stack(part["vector"].to_numpy()).astype(np.float64), part["n"].to_numpy(dtype=np.float64)
        labels = cut(chain_merges(sizes, means), len(sizes), wanted)
        total = np.bincount(labels, weights=sizes)
        out = np.zeros((len(total), means.shape[1]))
        np.add.at(out, labels, means * sizes[:, None])
        return pd.DataFrame({"vector": list(out / total[:, None]), "n": total.astype(np.int64)})

    return merge


def features(rows: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """``vector, n``: at most ``leaves`` cluster features of the column ``vector``; rows without a vector have none."""
    found = settled(rows.where("vector is not null").groupBy("vector").agg(F.count(F.lit(1)).alias("n")))
    number = found.count()
    while number > leaves:
        buckets = -(-number // (FACTOR * leaves))
        wanted = leaves if buckets == 1 else max(1, leaves // 2)
        dealt = found.withColumn("bucket", F.pmod(F.xxhash64("vector"), F.lit(buckets)))
        found = settled(dealt.groupBy("bucket").applyInPandas(_merged_to(wanted), "vector array<double>, n bigint"))
        number = found.count()
    return found


@dataclass
class Hierarchy:
    """Leaves in the order of their means, and the merges over them in ascending height."""

    means: np.ndarray
    sizes: np.ndarray
    merges: np.ndarray

    def cut(self, clusters: int) -> np.ndarray:
        """The cluster of each leaf."""
        return cut(self.merges, len(self.sizes), clusters)


def hierarchy(rows: DataFrame, leaves: int = LEAVES) -> Hierarchy:
    """The Ward hierarchy of the column ``vector``; ``leaves`` bounds what reaches the driver."""
    part = features(rows, leaves).toPandas()
    if part.empty:
        return Hierarchy(np.zeros((0, 0)), np.zeros(0), chain_merges(np.zeros(0), np.zeros((0, 0))))
    part = part.sort_values("vector", key=lambda column: column.map(tuple))
    means, sizes = np.stack(part["vector"].to_numpy()).astype(np.float64), part["n"].to_numpy(dtype=np.float64)
    return Hierarchy(means, sizes, chain_merges(sizes, means))


def assigned(rows: DataFrame, tree: Hierarchy, clusters: int) -> DataFrame:
    """Adds ``cluster``: that of the nearest leaf; null without a vector. One pass, no shuffle."""
    labels, means = tree.cut(clusters), tree.means

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = batch["vector"].notna().to_numpy() & (len(means) > 0)
            out = pd.Series(pd.array([None] * len(batch), dtype="Int64"), index=batch.index)
            if known.any():
                best, _ = closest(np.stack(batch["vector"][known].to_numpy()).astype(np.float64), means)
                out[known] = labels[best]
            yield batch.assign(cluster=out)

    return rows.mapInPandas(place, T.StructType([*rows.schema.fields, T.StructField("cluster", T.LongType())]))


def merge_table(rows: DataFrame, tree: Hierarchy) -> DataFrame:
    """``place, height, size``: merges from the lowest on, with the rows of the cluster that each makes."""
    sizes, out = tree.sizes.copy(), []
    for place, (one, other, height) in enumerate(tree.merges, 1):
        sizes[other] += sizes[one]
        out.append((place, float(height), int(sizes[other])))
    return rows.sparkSession.createDataFrame(out, "place int, height double, size bigint")

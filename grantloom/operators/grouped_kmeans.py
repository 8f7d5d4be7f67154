"""K-means inside every group of a table at once.

Child levels of a hierarchy would take one fit per parent.  Here all parents share each pass: a row is
compared with the centres of its own group only, in blocks that are packed once, and the merged
sums (groups x centres x dimensions numbers) become the next centres.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import RDD
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantloom.operators import blocks
from grantloom.operators.blocks import closest
from grantloom.operators.ranking import first_rows

#: Distinct vectors of a group that a start is chosen from, per centre; rounds are a guard, fits end by tolerance.
SEED_VECTORS_PER_CENTRE, MOST_ROUNDS, TOLERANCE = 32, 300, 1e-4


def plus_plus(matrix: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ starting centres; fewer when there are fewer distinct rows."""
    matrix = np.unique(matrix, axis=0)
    k = min(k, len(matrix))
    random = np.random.RandomState(seed)
    chosen = [random.randint(len(matrix))]
    gap = ((matrix - matrix[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chosen.append(int(random.choice(len(matrix), p=gap / gap.sum())))
        gap = np.minimum(gap, ((matrix - matrix[chosen[-1]]) ** 2).sum(axis=1))
    return matrix[chosen]


def _by_group(batch: pd.DataFrame, centres: dict[int, np.ndarray]):
    for group, part in batch.groupby("group"):
        matrix = np.stack(part["vector"].to_numpy()).astype(np.float64)
        yield group, part, matrix, *closest(matrix, centres[group])


def _centres(rows: pd.DataFrame) -> dict[int, np.ndarray]:
    return {group: np.stack(part.sort_values("centre")["vector"].to_numpy()) for group, part in rows.groupby("group")}


def _starting(seed: int):
    def begin(part: pd.DataFrame) -> pd.DataFrame:
        chosen = plus_plus(np.stack(part["vector"].to_numpy()), int(part["k"].iloc[0]), seed)
        return pd.DataFrame({"group": int(part["group"].iloc[0]), "centre": np.arange(len(chosen)), "vector": list(chosen)})

    return begin


def fit(
    rows: DataFrame, max_centres: int, seed: int = 42, iterations: int = MOST_ROUNDS, tolerance: float = TOLERANCE, starts: int = 1
) -> dict[int, np.ndarray]:
    """Centres per group, of the start with the least cost.

    ``rows`` has ``(id, group int, k int, vector array<double>)`` and is read three times, so the caller should
    hold it in a stored or persisted form; the iterations run over its blocks.  Starting centres come from the distinct vectors of
    each group in digest order, so a group gets fewer than ``k`` centres only if it has fewer distinct
    vectors.  A group has settled when the squared moves of its centres add up to at most ``tolerance`` times
    the mean variance of its coordinates, as in the usual single-machine fit.
    """
    distinct = rows.groupBy("group", "vector").agg(F.max("k").alias("k"))
    digest = F.md5(F.array_join(F.col("vector").cast("array<string>"), ","))
    sample = first_rows(
        distinct.withColumn("digest", digest), ["group"], [F.col("digest")], SEED_VECTORS_PER_CENTRE * max_centres
    ).drop("digest", "place").persist()
    found: dict[int, np.ndarray] = {}
    variances = Summarizer.variance(array_to_vector("vector"))
    # One number per group; of the distinct vectors, so copies do not shrink it.
    by_group = distinct.groupBy("group").agg(vector_to_array(variances).alias("v")).collect()
    spread = {r["group"]: float(np.mean(r["v"])) for r in by_group}
    least, packed = None, blocks.packed(rows)
    try:
        for start in range(starts):
            seeds = sample.groupBy("group").applyInPandas(_starting(seed + start), "group int, centre int, vector array<double>")
            centres = _centres(seeds.toPandas())  # groups x centres rows
            for _ in range(iterations):
                moved, cost = _step(packed, centres)
                open_groups = [g for g in centres if ((moved[g] - centres[g]) ** 2).sum() > tolerance * spread[g]]
                centres = moved
                if not open_groups:
                    break
            if least is None or cost < least:
                found, least = centres, cost
    finally:
        sample.unpersist()
        packed.unpersist()
    return found


def _step(packed: RDD, centres: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], float]:
    """Centres after one pass, and the cost of the centres before it."""
    moved, cost = {group: found.copy() for group, found in centres.items()}, 0.0
    for group, (counts, costs, sums) in blocks.step(packed, centres).items():
        met = counts > 0
        moved[group][met] = sums[met] / counts[met, None]
        cost += float(costs.sum())
    return moved, cost


def assign(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Adds the local ``centre`` to every row, keeping its other columns; one pass, no shuffle."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part, _, best, _ in _by_group(batch, centres):
                yield part.assign(centre=best.astype("int32"))

    schema = T.StructType([*rows.schema.fields, T.StructField("centre", T.IntegerType())])
    return rows.mapInPandas(place, schema)


def centres_per_group(rows: DataFrame, rule: Column, total: int) -> DataFrame:
    """Adds ``k`` by a rule written on the group size ``n`` and the table size ``total``.

    Group sizes enter as one map in a scalar subquery: one entry per group of the level above.
    """
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.lit(total))
    sizes = sizes.select("group", rule.cast("int").alias("k"))
    table = sizes.agg(F.map_from_entries(F.collect_list(F.struct("group", "k")))).scalar()
    return rows.withColumn("__k", table).withColumn("k", F.try_element_at("__k", F.col("group"))).drop("__k")

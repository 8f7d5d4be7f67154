"""Nearest neighbours, nearest centroids and box neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantloom.session import settled

BLOCK_ROWS = 4096
SIMILARITY_DIGITS = 9
#: Cells of the references (their centres are in every task), sampled rows per cell, rounds that place the centres.
MOST_CELLS, SAMPLE_PER_CELL, PIVOT_ROUNDS = 1024, 8, 5
#: Cells a query has visited after each round but the last; angle that rounding may hide.
ROUND_EDGES, SLACK = (1, 8), 1e-7
#: Queries compared at once; a shelf is answered cell by cell if queries visit one cell in so many; score of other cells.
SLICE_ROWS, FEW, NOT_VISITED = 512, 8, -3.0


def _unit_rows(values: pd.Series) -> np.ndarray:
    matrix = np.stack(values.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _visited(part: pd.DataFrame, cells: np.ndarray) -> np.ndarray:
    """Which of the ``cells`` each query visits."""
    row, cell = np.repeat(np.arange(len(part)), part["cells"].map(len)), np.concatenate(part["cells"].to_list())
    at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
    known, out = cells[at] == cell, np.zeros((len(part), len(cells)), dtype=bool)
    out[row[known], at[known]] = True
    return out


def block_best(queries: pd.DataFrame, references: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` most cosine-similar references of each query inside one pair of blocks.

    If the references have a ``cell``, a query is compared with those of its ``cells``; a ``floor`` is a similarity that its
    neighbours reach. Queries are compared in slices, so that a task holds a slice of the scores.
    """
    parts = []
    if not queries.empty and not references.empty:
        references = references.sort_values("reference_id")
        ids, theirs = references["reference_id"].to_numpy(), _unit_rows(references["vector"])
        kept, step = min(k, len(ids)), 10.0**-SIMILARITY_DIGITS
        cells, own = np.unique(references["cell"], return_inverse=True) if "cell" in references else (np.zeros(1), None)
        for start in range(0, len(queries), SLICE_ROWS):
            part = queries.iloc[start : start + SLICE_ROWS]
            scores = _unit_rows(part["vector"]) @ theirs.T
            if len(cells) > 1:
                scores[~_visited(part, cells)[:, own]] = NOT_VISITED
            floor = part["floor"].to_numpy().copy() if "floor" in part else np.full(len(part), -2.0)
            open_ = floor < -1.5
            floor[open_] = np.partition(scores[open_], len(ids) - kept, axis=1)[:, len(ids) - kept]
            row, col = np.nonzero(scores >= np.maximum(floor - 2 * step, -1.5)[:, None])
            found = np.round(scores[row, col], SIMILARITY_DIGITS)
            # References are in id order, so ties are broken by id.
            order = np.lexsort((col, -found, row))
            row, col, found = row[order], col[order], found[order]
            first = np.arange(len(row)) - np.searchsorted(row, np.arange(len(part)))[row] < kept
            parts.append((part["query_id"].to_numpy()[row[first]], ids[col[first]], found[first]))
    names = ("query_id", "reference_id", "similarity")
    return pd.DataFrame({n: np.concatenate([p[i] for p in parts]) if parts else [] for i, n in enumerate(names)})


def shelf_best(queries: pd.DataFrame, references: pd.DataFrame, k: int) -> pd.DataFrame:
    """The same for references of several cells; cell by cell if queries visit few of them."""
    cells = references["cell"].unique() if len(references) else []
    if len(cells) < 2 or queries["cells"].map(len).sum() * FEW >= len(queries) * len(cells):
        return block_best(queries, references, k)
    place = np.repeat(np.arange(len(queries)), queries["cells"].map(len))
    visits = pd.Series(place).groupby(np.concatenate(queries["cells"].to_list())).apply(np.asarray)
    plain = queries[["query_id", "vector", "floor"]]
    parts = [block_best(plain.iloc[visits[cell]], own.drop(columns="cell"), k) for cell, own in references.groupby("cell") if cell in visits.index]
    return pd.concat(parts) if parts else block_best(queries.iloc[:0], references, k)


def _angles(vectors: pd.Series, centres: np.ndarray, reference: bool) -> np.ndarray:
    """Angle of every vector to every centre. A vector of zeros is at a right angle to all, on an axis of its own."""
    units = _unit_rows(vectors)
    zero = ~units.any(axis=1)
    own = np.zeros((len(units), 2))
    own[zero, 0 if reference else 1] = 1.0
    return np.arccos(np.clip(np.hstack([units, own]) @ centres.T, -1.0, 1.0))


def _pivots(references: DataFrame, cells: int) -> np.ndarray:
    """Directions of the cells: spherical k-means on a bounded sample, the rows with the least hash of their id."""
    sample = references.orderBy(F.xxhash64("reference_id"), "reference_id").limit(SAMPLE_PER_CELL * cells).toPandas()
    units = _unit_rows(sample["vector"])
    units = np.hstack([units, (~units.any(axis=1))[:, None], np.zeros((len(units), 1))])
    centres = units[np.linspace(0, len(units) - 1, cells).astype(int)]
    for _ in range(PIVOT_ROUNDS):
        nearest = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1.0), centres)
    return centres


def _in_cells(references: DataFrame, centres: np.ndarray) -> DataFrame:
    kind = references.schema["reference_id"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            angles = _angles(batch["vector"], centres, True)
            cell = angles.argmin(axis=1)
            yield batch[["reference_id", "vector"]].assign(cell=cell.astype("int32"), angle=angles[np.arange(len(cell)), cell])

    return references.mapInPandas(place, f"reference_id {kind}, vector array<double>, cell int, angle double")


def _slices(batches: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]


def _shelves(facts: pd.DataFrame, rows: int) -> np.ndarray:
    """Neighbouring cells share a shelf of about ``rows`` references, so that a query is sent once for all of them."""
    before = np.cumsum(facts["n"].to_numpy()) - facts["n"].to_numpy()
    return np.unique(before // rows, return_inverse=True)[1].astype("int32")


def _visits(queries: DataFrame, centres: np.ndarray, facts: pd.DataFrame, shelves: np.ndarray, first: int, last: int) -> DataFrame:
    """``query_id, vector, floor, shelf, cells``: of each query's cells from place ``first`` to ``last``, best bound first, those within reach.

    By the triangle inequality no reference of a cell is nearer than the angle to the centre less the radius of the cell;
    ``floor`` is the similarity of the query's last neighbour so far.
    """
    known, radius = facts["cell"].to_numpy(), facts["radius"].to_numpy()
    kind = queries.schema["query_id"].dataType.simpleString()

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            gaps = np.maximum(_angles(batch["vector"], centres, False)[:, known] - radius - SLACK, 0.0)
            order = np.argsort(gaps, axis=1, kind="stable")[:, first:last]
            bound = np.cos(np.take_along_axis(gaps, order, axis=1))
            row, place = np.nonzero(bound >= batch["floor"].to_numpy()[:, None] - 10.0**-SIMILARITY_DIGITS)
            at = order[row, place]
            sort = np.lexsort((at, shelves[at], row))
            row, at = row[sort], at[sort]
            starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (shelves[at[1:]] != shelves[at[:-1]])])) if len(row) else row
            cells = np.split(known[at].astype("int32"), starts[1:])
            for low in range(0, len(starts), BLOCK_ROWS):
                own = starts[low : low + BLOCK_ROWS]
                out = batch[["query_id", "vector", "floor"]].iloc[row[own]]
                yield out.assign(shelf=shelves[at[own]], cells=cells[low : low + BLOCK_ROWS])

    return queries.select("query_id", "vector", "floor").mapInPandas(
        reach, f"query_id {kind}, vector array<double>, floor double, shelf int, cells array<int>"
    )


def _blocks(counts: dict[int, int], block_rows: int) -> Column:
    """Blocks of a shelf by its rows; one entry per shelf, which ``MOST_CELLS`` bounds."""
    shelves = F.create_map(*[F.lit(x) for shelf, n in counts.items() for x in (shelf, -(-n // block_rows))])
    return F.coalesce(F.try_element_at(shelves, F.col("shelf")), F.lit(0))


def _best_in_shelves(visits: DataFrame, placed: DataFrame, counts: dict[int, int], asked: dict[int, int], k: int, block_rows: int) -> DataFrame:
    """The ``k`` best references of each query in the cells it visits on each shelf; a task holds one block of either side."""
    mine, theirs = _blocks(asked, block_rows), _blocks(counts, block_rows)
    spread = lambda number: F.explode(F.sequence(F.lit(0).cast("long"), (number - 1).cast("long")))
    left = visits.select("*", F.pmod(F.xxhash64("query_id"), mine).alias("qb"), spread(theirs).alias("rb"))
    right = placed.where(mine > 0).select(
        "reference_id", "vector", "cell", "shelf", F.pmod(F.xxhash64("reference_id"), theirs).alias("rb"), spread(mine).alias("qb")
    )
    keys = ["shelf", "qb", "rb"]
    names = {c: f.schema[c].dataType.simpleString() for c, f in (("query_id", visits), ("reference_id", placed))}

    def pair(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return shelf_best(q, r[["reference_id", "vector", "cell"]], k)

    out = ", ".join(f"{c} {kind}" for c, kind in names.items()) + ", similarity double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair, out)


def _no_neighbors(queries: DataFrame, references: DataFrame) -> DataFrame:
    kinds = [frame.schema[c].dataType.simpleString() for c, frame in (("query_id", queries), ("reference_id", references))]
    return queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, reference_id {kinds[1]}, similarity double, place int")


def cosine_neighbors(
    queries: DataFrame, references: DataFrame, k: int, block_rows: int = BLOCK_ROWS, report: list[tuple[int, int]] | None = None
) -> DataFrame:
    """Exact ``k`` nearest references by cosine similarity: ``query_id, reference_id, similarity, place``.

    Expects ``(query_id, vector)`` and ``(reference_id, vector)``; rows without a vector have no neighbours. References
    are dealt to cells around directions, about ``block_rows`` each but at most ``MOST_CELLS`` of them. A query first
    visits the cell that can hold its nearest reference; the similarity of its ``k``-th best so far then rules out all
    cells whose bound is lower, and the same again after a few more cells. Small cells share shelves, so a query travels once
    for each shelf; crowded shelves and those that many queries visit are cut into blocks, so every task is bounded. ``report`` gets the number of cells and visits of each round.
    """
    queries, references = queries.where("vector is not null"), references.where("vector is not null")
    total = references.count()
    if not total:
        return _no_neighbors(queries, references)
    cells = min(MOST_CELLS, max(1, -(-total // block_rows)))
    centres = _pivots(references, cells)
    placed = settled(_in_cells(references, centres))
    facts = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).orderBy("cell").toPandas()
    shelf_rows = max(block_rows, BLOCK_ROWS)
    shelves = _shelves(facts, shelf_rows)
    counts = facts.groupby(shelves)["n"].sum().to_dict()
    shelf_of = F.create_map(*[F.lit(x) for pair in zip(facts["cell"].tolist(), shelves.tolist(), strict=True) for x in pair])
    placed = placed.withColumn("shelf", shelf_of[F.col("cell")])
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "reference_id")

    def merged(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    found, edges = None, [0, *(e for e in ROUND_EDGES if e < len(facts)), len(facts)]
    for first, last in zip(edges, edges[1:]):
        if found is None:
            now = queries.withColumn("floor", F.lit(-2.0))
        else:
            floors = found.where(F.col("place") == k).select("query_id", F.col("similarity").alias("floor"))
            now = queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        visits = settled(_visits(now, centres, facts, shelves, first, last))
        met = visits.groupBy("shelf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("cells")).alias("cells")).collect()
        asked = {r["shelf"]: r["n"] for r in met}
        if report is not None:
            report.append((len(facts), sum(r["cells"] for r in met)))
        if asked:
            best = _best_in_shelves(visits, placed, counts, asked, k, shelf_rows)
            found = settled(merged(best if found is None else found.drop("place").unionByName(best)))
    return _no_neighbors(queries, references) if found is None else found


def nearest_centroid(points: DataFrame, centroids: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Adds ``cluster_id`` and ``cluster_distance`` of the closest centroid.

    ``centroids`` has ``(cluster_id, centroid_x, centroid_y)``, one row per cluster; it enters the plan
    as a scalar subquery holding one array, so points are not shuffled.
    """
    packed = centroids.agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.col("cluster_id").alias("id"), F.col("centroid_x").alias("cx"), F.col("centroid_y").alias("cy"))
            )
        )
    )

    def step(cell: Column) -> Column:
        distance = F.sqrt(F.pow(F.col(x) - cell["cx"], 2) + F.pow(F.col(y) - cell["cy"], 2))
        return F.struct(distance.alias("distance"), cell["id"].alias("id"))

    best = F.array_min(F.transform(F.col("__centroids"), step))
    return (
        points.withColumn("__centroids", packed.scalar())
        .withColumn("__best", best)
        .withColumns({"cluster_id": F.col("__best.id"), "cluster_distance": F.col("__best.distance")})
        .drop("__centroids", "__best")
    )


def box_neighbors(
    centers: DataFrame, points: DataFrame, center_id: str, point_id: str, radius: float, limit: int | None
) -> DataFrame:
    """Points with both coordinates closer than ``radius`` to a center.

    Grid cells of side ``radius`` turn the range condition into an equality on nine cells; the exact
    condition is checked afterwards.  With ``limit`` only the first points by id are kept per center.
    """
    cell = lambda column: F.floor(F.col(column) / radius)
    around = F.explode(F.array(*[F.lit(step) for step in (-1, 0, 1)]))
    left = (
        centers.select(center_id, F.col("x").alias("cx"), F.col("y").alias("cy"))
        .withColumn("dx", around)
        .withColumn("dy", around)
        .withColumns({"gx": cell("cx") + F.col("dx"), "gy": cell("cy") + F.col("dy")})
        .drop("dx", "dy")
    )
    right = points.withColumns({"gx": cell("x"), "gy": cell("y")})
    close = (F.abs(F.col("x") - F.col("cx")) < radius) & (F.abs(F.col("y") - F.col("cy")) < radius)
    pairs = right.join(left, ["gx", "gy"]).where(close).drop("gx", "gy", "cx", "cy")
    if limit is None:
        return pairs
    order = Window.partitionBy(center_id).orderBy(point_id)
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


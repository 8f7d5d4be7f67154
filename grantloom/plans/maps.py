"""Tables behind the map: centres, density grid, regions, zoom levels, neighbourhood cards."""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantloom.functions.numbers import rounded
from grantloom.operators.neighbors import box_neighbors
from grantloom.operators.ranking import shuffled_head

GRID = 50
THRESHOLD = 0.1
POINTS_PER_ZOOM = 3000


def level_centres(points: DataFrame) -> DataFrame:
    """Centre, size and full label of every domain, topic and subtopic, from one aggregation.

    The finest level is aggregated from the points; coarser levels are sums over it.
    """
    leaves = points.groupBy("domain", "domain_label", "topic", "subtopic").agg(
        F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count(F.lit(1)).alias("n")
    )
    topic_label = F.concat(F.col("domain_label"), F.lit(" - Topic "), F.col("topic"))
    labels = {
        "domain": F.col("domain_label"),
        "topic": topic_label,
        "subtopic": F.concat(topic_label, F.lit(" - Subtopic "), F.col("subtopic")),
    }
    cells = F.array(
        *[F.struct(F.lit(level).alias("level"), F.col(level).alias("id"), label.alias("label")) for level, label in labels.items()]
    )
    return (
        leaves.select("sx", "sy", "n", F.inline(cells))
        .groupBy("level", "id", "label")
        .agg(
            rounded(F.sum("sx") / F.sum("n"), 4).alias("x"),
            rounded(F.sum("sy") / F.sum("n"), 4).alias("y"),
            F.sum("n").alias("count"),
        )
    )


def density_grid(points: DataFrame, grid: int = GRID, threshold: float = THRESHOLD) -> DataFrame:
    """Share of the fullest cell per domain on a ``grid`` by ``grid`` raster, cells above the threshold."""
    extent = points.agg(
        F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    ).scalar()
    placed = points.select("domain", "x", "y").withColumn("box", extent)

    def cell(value: str, low: str, high: str):
        width = F.col(f"box.{high}") - F.col(f"box.{low}")
        step = F.floor((F.col(value) - F.col(f"box.{low}")) * grid / width)
        return F.least(step, F.lit(grid - 1)).cast("int")

    counts = (
        placed.withColumns({"cell_x": cell("x", "x0", "x1"), "cell_y": cell("y", "y0", "y1")})
        .groupBy("domain", "cell_x", "cell_y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    peaks = counts.groupBy("domain").agg(F.max("n").alias("peak"))
    return (
        counts.join(peaks, "domain")
        .select("domain", "cell_x", "cell_y", "n", rounded(F.col("n") / F.col("peak"), 6).alias("intensity"))
        .where(F.col("intensity") > threshold)
    )


# Deviation of the smoothing kernel in cells; it ends at three deviations.
SIGMA = 1.5


def kernel(sigma: float = SIGMA) -> list[float]:
    """Weights of a cell's contribution to its neighbours on one axis, from the left end to the right."""
    reach = math.ceil(3 * sigma)
    raw = [math.exp(-step * step / (2 * sigma * sigma)) for step in range(-reach, reach + 1)]
    return [weight / sum(raw) for weight in raw]


def smoothed(cells: DataFrame, axis: str, grid: int, weights: list[float]) -> DataFrame:
    """Every cell gives its neighbours on one axis their share; cells meet as sums, so a full grid is never built."""
    reach = len(weights) // 2
    steps = F.explode(F.array(*[F.struct(F.lit(i - reach).alias("by"), F.lit(w).alias("weight")) for i, w in enumerate(weights)]))
    others = [c for c in ("domain", "cell_x", "cell_y") if c != axis]
    given = cells.withColumn("step", steps).select(*others, (F.col(axis) + F.col("step.by")).alias(axis), (F.col("n") * F.col("step.weight")).alias("n"))
    return given.where(F.col(axis).between(0, grid - 1)).groupBy("domain", "cell_x", "cell_y").agg(F.sum("n").alias("n"))


def heat_map(points: DataFrame, grid: int = GRID, threshold: float = THRESHOLD, sigma: float = SIGMA) -> DataFrame:
    """Smoothed intensity per domain on the raster: ``domain, cell_x, cell_y, x, y, intensity`` of cells above the threshold.

    A Gaussian is applied along x and then along y, which equals the two-dimensional convolution with nothing outside the
    raster; the intensity is the share of the domain's highest cell, at the middle of a cell.
    """
    extent = points.agg(F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))).scalar()
    placed = points.select("domain", "x", "y").withColumn("box", extent)
    low = {"cell_x": ("x", "x0", "x1"), "cell_y": ("y", "y0", "y1")}
    width = {c: F.nullif(F.col(f"box.{b}") - F.col(f"box.{a}"), F.lit(0.0)) for c, (_, a, b) in low.items()}
    step = {c: F.floor((F.col(v) - F.col(f"box.{a}")) * grid / width[c]) for c, (v, a, _) in low.items()}
    cells = placed.withColumns({c: F.coalesce(F.least(s, F.lit(grid - 1)), F.lit(0)).cast("int") for c, s in step.items()})
    cells = cells.groupBy("domain", "cell_x", "cell_y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    weights = kernel(sigma)
    spread = smoothed(smoothed(cells, "cell_x", grid, weights), "cell_y", grid, weights)
    peaks = spread.groupBy("domain").agg(F.max("n").alias("peak"))
    shares = spread.join(peaks, "domain").withColumn("intensity", rounded(F.col("n") / F.col("peak"), 6)).where(F.col("intensity") > threshold)
    middle = {v: rounded(F.col(f"box.{a}") + (F.col(c) + 0.5) * (F.col(f"box.{b}") - F.col(f"box.{a}")) / grid, 6) for c, (v, a, b) in low.items()}
    return shares.withColumn("box", extent).withColumns(middle).select("domain", "cell_x", "cell_y", "x", "y", "intensity")


def region_boxes(points: DataFrame) -> DataFrame:
    return points.groupBy("domain").agg(
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        F.count(F.lit(1)).alias("count"),
    )


def hull(xy: np.ndarray) -> np.ndarray:
    """Corner points of the convex hull, counter-clockwise from the leftmost point."""
    pts = np.unique(xy, axis=0)
    if len(pts) <= 2:
        return pts

    def chain(ordered: np.ndarray) -> list[np.ndarray]:
        line: list[np.ndarray] = []
        for p in ordered:
            while len(line) >= 2:
                a, b = line[-1] - line[-2], p - line[-2]
                if a[0] * b[1] - a[1] * b[0] > 0:
                    break
                line.pop()
            line.append(p)
        return line[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def _corners(domain: int, xy: np.ndarray) -> pd.DataFrame:
    found = hull(xy)
    return pd.DataFrame({"domain": domain, "corner": np.arange(len(found)), "x": found[:, 0], "y": found[:, 1]})


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for domain, part in batch.groupby("domain"):
            xy = part[["x", "y"]].to_numpy()
            held[domain] = hull(np.vstack([held[domain], xy]) if domain in held else xy)
    for domain, xy in held.items():
        yield _corners(domain, xy)


def region_outlines(points: DataFrame) -> DataFrame:
    """Convex hull per domain.

    Every partition reduces its points to the corners of its own hulls; the hull of those corners is the
    hull of all points, so the grouped step only sees corners.
    """
    schema = "domain int, corner int, x double, y double"
    corners = points.select("domain", "x", "y").mapInPandas(_partial, schema)

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return _corners(key[0], part[["x", "y"]].to_numpy())

    return corners.groupBy("domain").applyInPandas(merge, schema)


def zoom_points(points: DataFrame, zoom: float, key: str = "key") -> DataFrame:
    """Points shown at a zoom level: a budget that grows with the zoom, in digest order."""
    return shuffled_head(points, key, int(POINTS_PER_ZOOM * zoom))


def neighborhood_cards(centers: DataFrame, points: DataFrame, radius: float = 0.5, shown: int = 5) -> DataFrame:
    """The first grants near each chosen grant with their total funding."""
    near = box_neighbors(centers, points, "center", "key", radius, shown)
    return near.groupBy("center").agg(
        F.count(F.lit(1)).alias("grants"), F.sum("cost").cast("double").alias("total_funding")
    )

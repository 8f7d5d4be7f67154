"""Density clusters of points in the plane.

Cells of side ``eps / sqrt(2)`` make all points of one cell neighbours of each other. A cell that holds
``min_samples`` points is dense without comparing any pair, and clusters are connected components of cells.

Everything else asks how points, or cells, lie to the places of other cells: how many are in range, whether any is, which
is nearest. A cell answers with a summary (its places, their weight, the box around them and one of them) where the box is
wholly in or out of range. Only cells that the range cuts are looked into: place by place if they hold few, otherwise
by their sixteen parts, whose summaries answer in turn. So a cell of a million places is never compared place by place.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantloom.operators.components import components
from grantloom.session import settled

REACH = 2
#: Parts per side of a cell that is split, places of a cell that are compared one by one, and splits at most.
PARTS, DIRECT, DEEPEST = 4, 64, 12


def _cells(sites: DataFrame, side: float) -> DataFrame:
    return sites.withColumns({"gx": F.floor(F.col("x") / side), "gy": F.floor(F.col("y") / side)})


def _around(rows: DataFrame, own: bool) -> DataFrame:
    """One row per cell within reach as ``tx, ty``, the own cell included or not; corners cannot be in range."""
    steps = [
        (dx, dy)
        for dx in range(-REACH, REACH + 1)
        for dy in range(-REACH, REACH + 1)
        if abs(dx) + abs(dy) < 2 * REACH and (own or (dx, dy) != (0, 0))
    ]
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps])
    return (
        rows.withColumn("step", F.explode(offsets))
        .withColumns({"tx": F.col("gx") + F.col("step.dx"), "ty": F.col("gy") + F.col("step.dy")})
        .drop("step")
    )


def _gap(a: str, b: str) -> Column:
    return F.sqrt(F.pow(F.col(f"{a}x") - F.col(f"{b}x"), 2) + F.pow(F.col(f"{a}y") - F.col(f"{b}y"), 2))


def _summaries(sites: DataFrame, side: float, prefix: str = "t", *more: Column) -> DataFrame:
    """Per cell: ``places``, their ``weight``, one of them and the box around them, under names that start with ``prefix``."""
    ends = [f(c).alias(f"{prefix}{c}{n}") for c in ("x", "y") for n, f in (("0", F.min), ("1", F.max))]
    one = F.min(F.struct("x", "y"))
    keys = [F.floor(F.col(c) / side).alias(f"{prefix}{c}") for c in ("x", "y")]
    found = sites.groupBy("group", *keys).agg(
        F.count(F.lit(1)).alias(f"{prefix}places"), F.sum("n").alias(f"{prefix}weight"), one.alias(f"{prefix}one"), *ends, *more
    )
    return found


def _apart(low: Column, high: Column, low2: Column, high2: Column) -> Column:
    """Least distance of two intervals."""
    return F.greatest(low2 - high, low - high2, F.lit(0.0))


def _spread(low: Column, high: Column, low2: Column, high2: Column) -> Column:
    return F.greatest(high2 - low, high - low2)


def _box_gap(measure, a: dict[str, str], b: dict[str, str]) -> Column:
    parts = [F.pow(measure(*(F.col(s[f"{c}{e}"]) for s in (a, b) for e in ("0", "1"))), 2) for c in ("x", "y")]
    return F.sqrt(parts[0] + parts[1])


def _box(prefix: str) -> dict[str, str]:
    return {f"{c}{e}": f"{prefix}{c}{e}" for c in ("x", "y") for e in ("0", "1")}


#: A point is a box without extent.
POINT = {"x0": "px", "x1": "px", "y0": "py", "y1": "py"}


def _parts_of(rows: DataFrame, prefix: str = "t") -> DataFrame:
    """The parts of every cell, under the cell's names."""
    keys = [f"{prefix}x", f"{prefix}y"]
    for key in keys:
        rows = rows.withColumn(key, F.explode(F.array(*[F.col(key) * PARTS + i for i in range(PARTS)])))
    return rows


def _in_cell(sites: DataFrame, side: float, prefix: str, out: str, *more: str) -> DataFrame:
    """Places under the names of their cell and ``out``."""
    keys = [F.floor(F.col(c) / side).alias(f"{prefix}{c}") for c in ("x", "y")]
    return sites.select("group", *keys, F.col("x").alias(f"{out}x"), F.col("y").alias(f"{out}y"), *more)


def _near_weight(thin: DataFrame, sites: DataFrame, eps: float, side: float) -> DataFrame:
    """``group, x, y, near``: weight of the places within ``eps`` of thin places, counted until ``least`` is reached.

    ``thin`` has ``(group, gx, gy, px, py, least)``.
    """
    key = ["group", "px", "py"]
    front, counted = _around(thin, own=True).select(*key, "least", "tx", "ty"), []
    for depth in range(DEEPEST + 1):
        met = front.join(_summaries(sites, side), ["group", "tx", "ty"])
        met = met.where(_box_gap(_apart, POINT, _box("t")) <= eps).withColumn("inside", _box_gap(_spread, POINT, _box("t")) <= eps)
        met = settled(met.select(*key, "least", "tx", "ty", "inside", "tplaces", "tweight"))
        few = (F.col("tplaces") <= DIRECT) | F.lit(depth == DEEPEST)
        sure = met.where("inside").select(*key, F.col("tweight").alias("n"))
        direct = met.where(~F.col("inside") & few).join(_in_cell(sites, side, "t", "q", "n"), ["group", "tx", "ty"])
        counted += [sure, direct.where(_gap("p", "q") <= eps).select(*key, "n")]
        rest = met.where(~F.col("inside") & ~few)
        if depth == DEEPEST or rest.isEmpty():
            break
        so_far = reduce(DataFrame.unionByName, counted).groupBy(*key).agg(F.sum("n").alias("so_far"))
        rest = rest.join(so_far, key, "left").where(F.coalesce("so_far", F.lit(0)) < F.col("least"))
        front, side = _parts_of(rest.select(*key, "least", "tx", "ty")), side / PARTS
    near = reduce(DataFrame.unionByName, counted).groupBy(*key).agg(F.sum("n").alias("near"))
    return near.withColumnsRenamed({"px": "x", "py": "y"})


def core_sites(sites: DataFrame, eps: float) -> DataFrame:
    """Distinct places ``(group, x, y, n, gx, gy)`` with ``is_core``; ``least`` are the samples a core needs."""
    side = eps / math.sqrt(2)
    weights = sites.groupBy("group", "gx", "gy").agg(F.sum("n").alias("cell_n"), F.max("least").alias("least"))
    dense = weights.where(F.col("cell_n") >= F.col("least")).select("group", "gx", "gy", F.lit(True).alias("dense"))
    marked = sites.join(dense, ["group", "gx", "gy"], "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
    thin = marked.where(~F.col("dense")).select(
        "group", "gx", "gy", F.col("x").alias("px"), F.col("y").alias("py"), "least"
    )
    counts = _near_weight(thin, sites.select("group", "x", "y", "n"), eps, side)
    return marked.join(counts, ["group", "x", "y"], "left").select(
        "group", "x", "y", "n", "gx", "gy",
        (F.col("dense") | (F.coalesce("near", F.lit(0)) >= F.col("least"))).alias("is_core"),
    )


def _links(cores: DataFrame, eps: float, side: float) -> DataFrame:
    """Pairs ``group, ax, ay, bx, by`` of neighbouring core cells with core places in range.

    A pair is linked if the places that stand for two cells, or their boxes, are in range, and not if the boxes are out
    of range; in between it is decided by the parts of both cells.
    """
    sites = cores.select("group", "x", "y", "n")
    pair = ["group", "ax", "ay", "bx", "by"]
    owned = _around(cores.select("group", "gx", "gy").distinct(), own=False)
    owned = owned.where("struct(gx, gy) < struct(tx, ty)")
    front = owned.select("group", *(F.col(c).alias(n) for n, c in zip(("ax", "ay", "bx", "by", "sx", "sy", "tx", "ty"), ("gx", "gy", "tx", "ty") * 2)))
    linked = []
    for depth in range(DEEPEST + 1):
        met = front.join(_summaries(sites, side, "s"), ["group", "sx", "sy"]).join(_summaries(sites, side, "t"), ["group", "tx", "ty"])
        between = F.sqrt(F.pow(F.col("sone.x") - F.col("tone.x"), 2) + F.pow(F.col("sone.y") - F.col("tone.y"), 2))
        met = met.where(_box_gap(_apart, _box("s"), _box("t")) <= eps).withColumn("sure", between <= eps)
        met = settled(met.select(*pair, "sx", "sy", "tx", "ty", "sure", "splaces", "tplaces"))
        sure = met.where("sure").select(*pair).distinct()
        linked.append(sure)
        rest = met.where("not sure").join(sure, pair, "left_anti")
        few = ((F.col("splaces") <= DIRECT) & (F.col("tplaces") <= DIRECT)) | F.lit(depth == DEEPEST)
        direct = rest.where(few).join(_in_cell(sites, side, "s", "p"), ["group", "sx", "sy"])
        direct = direct.join(_in_cell(sites, side, "t", "q"), ["group", "tx", "ty"])
        linked.append(direct.where(_gap("p", "q") <= eps).select(*pair).distinct())
        rest = rest.where(~few)
        if depth == DEEPEST or rest.isEmpty():
            break
        front, side = _parts_of(_parts_of(rest.select(*pair, "sx", "sy", "tx", "ty"), "s"), "t"), side / PARTS
    return reduce(DataFrame.unionByName, linked).distinct()


def _nearest(front: DataFrame, targets: DataFrame, side: float, reach: float | None) -> DataFrame:
    """``group, x, y, cluster``: cluster of the nearest target within ``reach``, the least name of equally near ones.

    ``front`` has ``(group, px, py, tx, ty)``, the cells of ``side`` to look into; ``targets`` has ``(group, x, y,
    cluster)``. A cell is left out if its box is farther than some target that is known already.
    """
    key, found = ["group", "px", "py"], []
    sites = targets.withColumn("n", F.lit(1))
    for depth in range(DEEPEST + 1):
        met = front.join(_summaries(sites, side), ["group", "tx", "ty"])
        upper = F.sqrt(F.pow(F.col("tone.x") - F.col("px"), 2) + F.pow(F.col("tone.y") - F.col("py"), 2))
        met = met.select(*key, "tx", "ty", "tplaces", _box_gap(_apart, POINT, _box("t")).alias("lower"), upper.alias("upper"))
        if reach is not None:
            met = met.where(F.col("lower") <= reach)
        best = F.min("upper").over(Window.partitionBy(*key))  # the cells around one place
        met = settled(met.withColumn("best", best).where(F.col("lower") <= F.col("best")))
        few = (F.col("tplaces") <= DIRECT) | F.lit(depth == DEEPEST)
        direct = met.where(few).join(_in_cell(targets, side, "t", "q", "cluster"), ["group", "tx", "ty"]).withColumn("gap", _gap("p", "q"))
        if reach is not None:
            direct = direct.where(F.col("gap") <= reach)
        found.append(direct.groupBy(*key).agg(F.min(F.struct("gap", "cluster")).alias("near")))
        rest = met.where(~few)
        if depth == DEEPEST or rest.isEmpty():
            break
        front, side = _parts_of(rest.select(*key, "tx", "ty")), side / PARTS
    near = reduce(DataFrame.unionByName, found).groupBy(*key).agg(F.min("near").alias("near"))
    return near.select("group", F.col("px").alias("x"), F.col("py").alias("y"), "near.cluster")


def density_places(points: DataFrame, eps: float, min_samples: int | Column) -> DataFrame:
    """Density cluster per distinct place: ``(group, x, y, n, cluster)``; noise has no cluster.

    ``points`` has ``(group, x, y)``; groups are clustered apart.  ``min_samples`` is a number or an expression
    on the size ``n`` of a group.  Points at one place are one weighted
    place, so copies cost nothing.  A border place joins the cluster of its nearest core place.
    """
    side = eps / math.sqrt(2)
    places = points.groupBy("group", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    if isinstance(min_samples, Column):
        sizes = points.groupBy("group").agg(F.count(F.lit(1)).alias("n")).select("group", min_samples.alias("least"))
        places = places.join(sizes, "group")
    else:
        places = places.withColumn("least", F.lit(min_samples))
    marked = settled(core_sites(_cells(settled(places), side), eps))
    cores = marked.where("is_core")
    name = lambda x, y: F.concat_ws(",", "group", F.col(x), F.col(y))
    nodes = cores.select("group", "gx", "gy").distinct().withColumn("node", name("gx", "gy"))
    edges = _links(cores, eps, side).select(name("ax", "ay").alias("a"), name("bx", "by").alias("b"))
    found = components(nodes, edges)
    labelled = settled(cores.withColumn("node", name("gx", "gy")).join(found, "node").select(
        "group", "x", "y", F.col("label").alias("cluster")
    ))
    loose = marked.where("not is_core").select(
        "group", "gx", "gy", F.col("x").alias("px"), F.col("y").alias("py")
    )
    border = _nearest(_around(loose, own=True).select("group", "px", "py", "tx", "ty"), labelled, side, eps)
    placed = labelled.select("group", "x", "y", "cluster").unionByName(border)
    return settled(marked.select("group", "x", "y", "n").join(placed, ["group", "x", "y"], "left"))


def density_clusters(points: DataFrame, eps: float, min_samples: int | Column) -> DataFrame:
    """Density cluster per point: ``(id, group, x, y, cluster)``; noise has no cluster."""
    return on_points(points, density_places(points, eps, min_samples).drop("n"))


def on_points(points: DataFrame, places: DataFrame) -> DataFrame:
    return points.join(places, ["group", "x", "y"], "left")


def noise_to_nearest(places: DataFrame) -> DataFrame:
    """Gives noise places the cluster of their group whose mean over its points is nearest.

    The search starts at the few cells that hold all means of a group; groups without a cluster keep their noise.
    """
    weight = F.col("n").cast("double")
    means = settled(places.where("cluster is not null").groupBy("group", "cluster").agg(
        (F.sum(F.col("x") * weight) / F.sum(weight)).alias("x"), (F.sum(F.col("y") * weight) / F.sum(weight)).alias("y")
    ))
    ends = means.groupBy("group").agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))])
    widest = ends.agg(F.max(F.greatest(F.col("high_x") - F.col("low_x"), F.col("high_y") - F.col("low_y")))).first()[0]
    noise = places.where("cluster is null")
    if widest is None:  # no cluster anywhere
        return places.withColumn("was_noise", F.col("cluster").isNull())
    side = float(widest) or 1.0
    # Means within one side lie in at most two cells per axis.
    tops = means.select("group", F.floor(F.col("x") / side).alias("tx"), F.floor(F.col("y") / side).alias("ty")).distinct()
    asked = noise.select("group", F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    near = _nearest(asked.join(tops, "group"), means, side, None).withColumnRenamed("cluster", "given")
    joined = places.join(near, ["group", "x", "y"], "left")
    return joined.withColumn("was_noise", F.col("cluster").isNull()).withColumn("cluster", F.coalesce("cluster", "given")).drop("given")


def numbered(places: DataFrame) -> DataFrame:
    """Running topic numbers over all groups, in (group, cluster) order.

    Names are sorted in ranges, numbered inside each, and moved by the names of the ranges before: no window sees all.
    """
    names = places.where("cluster is not null").select("group", "cluster").distinct()
    ranges = settled(names.repartitionByRange("group", "cluster").withColumn("part", F.spark_partition_id()))
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # a row per range
    before = sizes.select("part", F.expr("sum(size) over (order by part) - size").alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("group", "cluster"))
    ids = ranges.withColumn("own", own).join(F.broadcast(before), "part")
    ids = ids.select("group", "cluster", (F.col("before") + F.col("own") - 1).cast("int").alias("topic"))
    return places.join(ids, ["group", "cluster"], "left")

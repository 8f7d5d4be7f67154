"""Roll-ups, distinct counts and top lists that stay flat under hot keys.

Every function aggregates before it shuffles on (entity, value), so an entity that owns a third
of the rows is spread over the values it owns instead of landing in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _unpivot(rows: DataFrame, keys: list[str], facets: dict[str, Column], carry: list[str]) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(name).alias("facet"), column.cast("string").alias("value")) for name, column in facets.items()]
    )
    return rows.select(*keys, *carry, F.explode(cells).alias("cell")).select(*keys, *carry, "cell.facet", "cell.value")


def rollup(
    rows: DataFrame,
    keys: list[str],
    by: str,
    sums: dict[str, str] | None = None,
    lows: dict[str, str] | None = None,
    highs: dict[str, str] | None = None,
    distinct: dict[str, str] | None = None,
) -> DataFrame:
    """One pass giving measures (SQL expressions by name) per (keys, ``by``) and one row per distinct facet value.

    Measure rows have ``facet = ''`` and carry ``by``, ``n`` and the measures; rows of a distinct
    facet carry its name only and NULL measures.  ``distinct_of`` counts them per entity.
    """
    sums, lows, highs, distinct = sums or {}, lows or {}, highs or {}, distinct or {}
    measures = {**sums, **lows, **highs}
    flat = rows.select(
        *keys,
        F.col(by).alias("__by"),
        *[F.expr(column).alias(f"__{name}") for name, column in measures.items()],
        *[F.expr(column).alias(f"__d_{name}") for name, column in distinct.items()],
    )
    facets = {"": F.col("__by")} | {name: F.col(f"__d_{name}") for name in distinct}
    long = _unpivot(flat, keys, facets, [f"__{name}" for name in measures])
    long = long.where((F.col("facet") == "") | F.col("value").isNotNull())
    mine = F.col("facet") == ""

    def on_measure_rows(function, name):
        return function(F.when(mine, F.col(f"__{name}"))).alias(name)

    grouped = long.groupBy(*keys, "facet", "value").agg(
        F.count_if(mine).alias("n"),
        *[on_measure_rows(F.sum, name) for name in sums],
        *[on_measure_rows(F.min, name) for name in lows],
        *[on_measure_rows(F.max, name) for name in highs],
    )
    return grouped.withColumn(by, F.when(mine, F.col("value"))).drop("value")


def distinct_of(name: str) -> Column:
    return F.count_if(F.col("facet") == name)


def top_values(rows: DataFrame, keys: list[str], tops: dict[str, tuple[str, int]]) -> DataFrame:
    """Exact most frequent values per entity as ``array<struct<value,count>>``.

    Ties are ordered by value.  The rank filter is a constant, so each task keeps at most
    ``k`` candidates per entity before the final sort.
    """
    flat = rows.select(*keys, *[F.expr(column).alias(f"__{name}") for name, (column, _) in tops.items()])
    long = _unpivot(flat, keys, {name: F.col(f"__{name}") for name in tops}, []).where(F.col("value").isNotNull())
    counts = long.groupBy(*keys, "facet", "value").agg(F.count(F.lit(1)).alias("n"))
    return top_of_counts(counts, keys, {name: k for name, (_, k) in tops.items()})


def top_of_counts(counts: DataFrame, keys: list[str], limits: dict[str, int]) -> DataFrame:
    order = Window.partitionBy(*keys, "facet").orderBy(F.col("n").desc(), F.col("value"))
    ranked = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(limits.values()))

    def gathered(name: str, k: int) -> Column:
        wanted = (F.col("facet") == name) & (F.col("place") <= k)
        cells = F.collect_list(F.when(wanted, F.struct("place", "value", F.col("n").alias("count"))))
        return F.transform(
            F.array_sort(cells), lambda cell: F.struct(cell["value"].alias("value"), cell["count"].alias("count"))
        ).alias(name)

    return ranked.groupBy(*keys).agg(*[gathered(name, k) for name, k in limits.items()])


def shown(column: str) -> Column:
    """A top list as text: ``value:count | value:count``."""
    cells = F.transform(
        F.col(column), lambda cell: F.concat(cell["value"], F.lit(":"), cell["count"].cast("string"))
    )
    return F.array_join(cells, " | ").alias(column)


def yearly_distinct(rows: DataFrame, keys: list[str], mask: Column, facets: dict[str, str]) -> DataFrame:
    """Distinct facet values per (keys, fiscal_year) without one row per award and year.

    Years of one value are merged as bits while aggregating; the series is generated from the
    merged mask afterwards.
    """
    from grantloom.functions.years import mask_years

    flat = rows.select(*keys, mask.alias("__mask"), *[F.expr(text).alias(f"__{name}") for name, text in facets.items()])
    long = _unpivot(flat, keys, {name: F.col(f"__{name}") for name in facets}, ["__mask"])
    merged = long.where(F.col("value").isNotNull()).groupBy(*keys, "facet", "value").agg(
        F.bit_or("__mask").alias("__mask")
    )
    years = merged.select(*keys, "facet", F.explode(mask_years(F.col("__mask"))).alias("fiscal_year"))
    return years.groupBy(*keys, "fiscal_year").agg(*[distinct_of(name).alias(name) for name in facets])


def attached(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which a missing key meets a missing key, as in one GROUP BY over all figures."""
    names = {key: f"__{key}" for key in keys}
    same = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(name)) for key, name in names.items()])
    return rows.join(more.withColumnsRenamed(names), same, "left").drop(*names.values())

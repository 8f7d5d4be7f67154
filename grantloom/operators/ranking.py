"""Exact row numbers inside groups of any size, and top rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grantloom.functions.numbers import digest_number

BUCKET_DIGITS = 3


def key_digest(key: str, salt: str = "") -> Column:
    """The md5 that orders rows; a missing key has the digest of an empty one."""
    return F.md5(F.concat(F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def _placed(rows: DataFrame, group: list[str], key: str, digits: int) -> tuple[DataFrame, list[str]]:
    """Rows with digest, bucket and null-safe group columns, and the names of these columns."""
    placed = rows.withColumn("__digest", key_digest(key)).withColumns(
        {"__bucket": F.substring("__digest", 1, digits)} | _null_safe(group)
    )
    return placed, list(_null_safe(group))


def _offsets(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and bucket the rows of the buckets before, and the rows of the group."""
    sizes = placed.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__size"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *keys,
        "__bucket",
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"),
        F.sum("__size").over(whole).alias("group_total"),
    )


def shuffled_rank(rows: DataFrame, group: list[str], key: str, digits: int = BUCKET_DIGITS) -> DataFrame:
    """Adds ``row_number`` (md5 order of ``key``) and ``group_total``.

    Equals ``row_number() over (partition by group order by md5(key), key)``.  The md5 order is
    cut into buckets by its leading ``digits`` hexadecimal digits; counts per bucket give each bucket its
    offset, and rows are numbered inside (group, bucket), so one hot group is spread over all buckets.
    Join and window share one partitioning, hence one shuffle of the rows.
    """
    placed, keys = _placed(rows, group, key, digits)
    own = [*keys, "__bucket"]
    inside = Window.partitionBy(*own).orderBy("__digest", key)
    numbered = placed.join(_offsets(placed, keys), own).withColumn(
        "row_number", (F.col("__before") + F.row_number().over(inside)).cast("bigint")
    )
    return numbered.drop("__digest", "__before", *own)


def quota_sample(rows: DataFrame, group: list[str], key: str, quota: Column | DataFrame, digits: int = BUCKET_DIGITS) -> DataFrame:
    """The first ``quota`` rows of every group in md5 order of ``key``.

    ``quota`` is an expression on ``group_total``, or a table of the group columns and ``quota``.  The
    counts per bucket tell in which bucket a group reaches its quota, so one row per group is joined to
    the rows and all later buckets are dropped before any row is shuffled; only what is left (the quota and
    at most one bucket more) is ranked.
    """
    placed, keys = _placed(rows, group, key, digits)
    offsets = _offsets(placed, keys)
    if isinstance(quota, Column):
        offsets = offsets.withColumn("__quota", quota)
    else:
        table = quota.select("quota", *(c.alias(n) for n, c in _null_safe(group).items()))
        offsets = offsets.join(table.withColumnRenamed("quota", "__quota"), keys) if keys else offsets.crossJoin(table)
    last = offsets.where(F.col("__before") < F.col("__quota")).groupBy(*keys).agg(
        F.max("__bucket").alias("__last"), F.max("__quota").alias("__quota")
    )
    near = placed.join(last, keys).where(F.col("__bucket") <= F.col("__last")).drop("__digest", "__bucket", "__last", *keys)
    ranked = shuffled_rank(near, group, key, digits)
    return ranked.where(F.col("row_number") <= F.col("__quota")).drop("row_number", "group_total", "__quota")


def _null_safe(group: list[str]) -> dict[str, Column]:
    """Two columns per key that are equal exactly when the keys are equal or both missing.

    Plain columns keep the partitioning of the join usable for the window behind it.
    """
    columns: dict[str, Column] = {}
    for name in group:
        columns[f"__key_{name}"] = F.coalesce(F.col(name).cast("string"), F.lit(""))
        columns[f"__none_{name}"] = F.col(name).isNull()
    return columns


def shuffled_head(rows: DataFrame, key: str, count: int, salt: str = "") -> DataFrame:
    """``count`` rows in md5 order of the salted ``key``: the repeatable form of a seeded random pick.

    A bounded ``count`` is a top list: every task sends its ``count`` first rows at most.  Another salt is an
    independent draw.
    """
    return rows.withColumn("__digest", key_digest(key, salt)).orderBy("__digest", key).limit(count).drop("__digest")


def first_rows(rows: DataFrame, group: list[str], order: list[Column], count: int) -> DataFrame:
    """The first ``count`` rows of every group; ``place`` numbers them.

    The constant bound on the rank lets every task drop all but ``count`` rows per group before
    the shuffle.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(window)).where(F.col("place") <= count)


def deduplicated(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Keeps the first row of each key in the given order."""
    return first_rows(rows, key, order, 1).drop("place")


def thinned(rows: DataFrame, key: str, step: int) -> DataFrame:
    """About every ``step``-th row, chosen by the digest of the key."""
    return rows.where(digest_number(F.col(key)) % step == 0)


def bernoulli(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """A repeatable Bernoulli sample of ``percent`` rows in a hundred."""
    return rows.where(digest_number(F.col(key)) % 100 < percent)

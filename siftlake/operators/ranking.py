"""First rows, places and states of sorted groups, without one task per group."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.sources.folders import kept


#: Rows that a task sorts or groups at once, about.
TASK_ROWS = 1 << 18


def dealt(rows: DataFrame, n: int, *keys: str, most: int = TASK_ROWS) -> DataFrame:
    """The rows, n of them, dealt by keys to so many tasks that each gets about `most` at the most, and to as many as the session's shuffles have at least.

    What a task sorts or groups then stays the same as the table grows, where a fixed number of partitions would grow with it.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(max(least, math.ceil(n / most)), *keys)


def dealt_if_many(rows: DataFrame, n: int, *keys: str, most: int = TASK_ROWS) -> DataFrame:
    """The rows, dealt as `dealt` does where the session's partitions would hold more than `most` each; fewer are left to Spark, which may broadcast what they meet."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return dealt(rows, n, *keys, most=most) if n > least * most else rows


def members_by_cube(rows: DataFrame, member: str, by: list[str]) -> DataFrame:
    """`members`, the distinct ones, of every group of a cube over `by`; a null member makes its group but does not count.

    Rows dealt by member are not dealt again: a member's cells are told apart where its rows are, and only counts of cells leave the task.
    """
    at = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in by]
    sets = [F.struct(*[F.col(c) if g >> i & 1 else at[i] for i, c in enumerate(by)], F.lit(g).alias("_set")) for g in range(1 << len(by))]
    cells = rows.select(member, F.inline(F.array(*sets))).distinct()
    return cells.groupBy(*by, "_set").agg(F.count(member).alias("members")).drop("_set")


def first_of_group(rows: DataFrame, group: list[str], order: list, n: int, salts: int = 32) -> DataFrame:
    """The first n rows of each group by order, with `rank`.

    A hot group is first cut to n rows in each of `salts` parts, so that the last ranking sees at
    most n * salts rows of it.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts))
    near = rows.withColumn("_salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy(*order))).where(F.col("rank") <= n)
    return near.drop("_salt", "rank").withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def in_ranges(rows: DataFrame, group: list[str], order: list, ranges: int | None = None) -> DataFrame:
    """The rows with `_range`: groups in order of their rows over ranges of about equal size, so a hot group fills many.

    Ranges are cut by a sample, so they are written down once: all that reads them sees the same ones.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return kept(rows.repartitionByRange(n, *group, *order).withColumn("_range", F.spark_partition_id()))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null."""
    other = right.withColumnsRenamed({k: f"_{k}_key" for k in keys})
    same = reduce(Column.__and__, [left[k].eqNullSafe(other[f"_{k}_key"]) for k in keys])
    return left.join(other, same, how).drop(*[f"_{k}_key" for k in keys])


def before_ranges(ranged: DataFrame, group: list[str], merged: Column, over, name: str) -> DataFrame:
    """group, _range and `name`: what an aggregate makes of all ranges of the group before; a row for each range that a group is in."""
    ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.groupBy(*group, "_range").agg(merged.alias("_own"))
    return own.select(*group, "_range", over("_own").over(ahead).alias(name))


def numbered(rows: DataFrame, group: list[str], order: list, name: str = "rank", ranges: int | None = None) -> DataFrame:
    """Every row's place in its group, from 1. Counted within ranges and over the ranges, so no task holds a group."""
    ranged = in_ranges(rows, group, order, ranges)
    ahead = before_ranges(ranged, group, F.count("*"), F.sum, "_before")
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)))
    joined = null_safe(placed, ahead, [*group, "_range"])
    return joined.withColumn(name, (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("int")).drop("_range", "_place", "_before")

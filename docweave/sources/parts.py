"""Partitions whose size doesn't grow with the input."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of input files a partition.
PART = 4 << 20
#: From here on a size is Spark's stand-in for an unknown one.
UNKNOWN = 1 << 60


def input_bytes(df: DataFrame) -> int:
    """What the plan's tables measure as files, by the optimizer's figures; no job. Rows handed over by the driver, whose size is unknown, count nothing."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(b for b in sizes if b < UNKNOWN)


def dealt(df: DataFrame, *keys: str | Column, size: int | None = None) -> DataFrame:
    """Dealt by keys to a number of partitions that follows the input, so that what one task sorts and holds stays the same.

    `size` in bytes replaces that of the files, which tells little where rows repeat. Windows and aggregations by these keys (and more) shuffle no further.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-(input_bytes(df) if size is None else size) // PART))
    return df.repartition(min(n, 20_000), *keys)


def looked_up(df: DataFrame, other: DataFrame, keys: list[str], found: Callable[[str], Column], to: str) -> DataFrame:
    """df with `to`: `found` aggregates the `_value` of the rows of `other` (keys, _value) with the same keys; null for null keys.

    A left join as a union and a window. Of tables that both are dealt by the first key to as many partitions none is shuffled again,
    which Spark would do for a join by more keys, or by that one where there are fewer partitions than its setting. No row multiplies.
    """
    both = df.withColumn("_mine", F.lit(True)).unionByName(other.select(*keys, "_value"), allowMissingColumns=True)
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return both.withColumn(to, F.when(known, found("_value").over(Window.partitionBy(*keys)))).where("_mine").drop("_mine", "_value")

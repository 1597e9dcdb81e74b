"""Ordered operators over keys of any length: a key is cut into ranges of its order.

What a window over a whole key would compute row after row is computed inside
(key, range), which one task sorts, and a row for each range, combined on the
way in, says what the earlier ranges add. A key with all rows of a table is as
many tasks as it has ranges. Results equal those of one window over the key,
whatever the ranges are: they must only grow with the order column, and equal
values must share a range. Nulls are a range of their own, before all others. Without ranges
a key is one window, which is less work where keys are many and short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The number of a value's range.
Ranges = Callable[[Column], Column]


def every(width: float) -> Ranges:
    """Ranges of equal width; needs no look at the data."""
    return lambda t: F.floor(t / F.lit(float(width)))


def balanced(df: DataFrame, order: str, n: int = 64, error: float = 1e-3) -> Ranges:
    """n ranges of about equally many rows, however skewed the order column is: one pass of mergeable sketches, of which n - 1 numbers reach the driver.

    A key with a third of all rows has about a third of the ranges to itself.
    """
    points = sorted(set(df.approxQuantile(order, [i / n for i in range(1, n)], error)))

    def number(t: Column) -> Column:
        def among(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            middle = (low + high + 1) // 2
            return F.when(t < points[middle - 1], among(low, middle - 1)).otherwise(among(middle, high))

        return F.when(t.isNotNull(), among(0, len(points)))

    return number


def inside(keys: list[str]):
    """The window of a key's range; the range is the column _r."""
    return Window.partitionBy(*keys, "_r")


def before(keys: list[str]):
    """The window of a key's earlier ranges, over one row for each range."""
    return Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)


def with_summary(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns that summary has for its key and range; null keys meet null keys."""
    s = summary.withColumnsRenamed({c: f"_s_{c}" for c in [*keys, "_r"]})
    on = [df[c].eqNullSafe(s[f"_s_{c}"]) for c in [*keys, "_r"]]
    return df.join(s, on, "left").drop(*[f"_s_{c}" for c in [*keys, "_r"]])


def ranked(df: DataFrame, keys: list[str], order: list[str], ranges: Ranges | None = None, name: str = "rank") -> DataFrame:
    """df with the number of each row in its key, from 0, and the key's number of rows as <name>_of; ranges cut the first column of order."""
    if ranges is None:
        w = Window.partitionBy(*keys)
        return df.withColumns({name: F.row_number().over(w.orderBy(*order)).cast("long") - 1, f"{name}_of": F.count("*").over(w)})
    laid = df.withColumn("_r", ranges(F.col(order[0])))
    counts = laid.groupBy(*keys, "_r").agg(F.count("*").alias("_n"))
    starts = counts.select(*keys, "_r", F.coalesce(F.sum("_n").over(before(keys)), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(*keys)).alias(f"{name}_of"))
    numbered = laid.withColumn("_local", F.row_number().over(inside(keys).orderBy(*order)) - 1)
    return with_summary(numbered, starts, keys).withColumn(name, F.col("_start") + F.col("_local")).select(*[F.col(f"`{c}`") for c in df.columns], name, f"{name}_of")


def previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], ranges: Ranges | None = None, name: str = "_before") -> DataFrame:
    """df with, as a struct, the columns of the row before it in its key; null for a key's first row."""
    value = F.struct(*columns)
    if ranges is None:
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    laid = df.withColumn("_r", ranges(F.col(order[0])))
    ends = laid.groupBy(*keys, "_r").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carry = ends.select(*keys, "_r", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_r")).alias("_carried"))
    w = inside(keys).orderBy(*order)
    here = laid.withColumns({"_lag": F.lag(value).over(w), "_first": F.row_number().over(w) == 1})
    return with_summary(here, carry, keys).withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag"))).drop("_r", "_carried", "_lag", "_first")


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, ranges: Ranges | None = None) -> DataFrame:
    """df with the sum of value from the key's first row to each row."""
    if ranges is None:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    laid = df.withColumn("_r", ranges(F.col(order[0])))
    sums = laid.groupBy(*keys, "_r").agg(F.sum(value).alias("_n"))
    starts = sums.select(*keys, "_r", F.coalesce(F.sum("_n").over(before(keys)), F.lit(0)).alias("_start"))
    summed = laid.withColumn("_sum", F.sum(value).over(inside(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return with_summary(summed, starts, keys).withColumn(name, F.col("_start") + F.col("_sum")).drop("_r", "_sum", "_start")

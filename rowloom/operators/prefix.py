"""Window values over a whole ordered dataset, without gathering it in one task.

Rows are dealt to ranges of the order; a window runs inside each range, and what a range needs from those before it (a
total, a last value, a few last rows) is one small row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "__range"


def in_ranges(df: DataFrame, order: str) -> DataFrame:
    """df with its range's number; persisted, as the ranges must be the same for all uses."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, order).withColumn(PART, F.spark_partition_id()).persist()


def _window(order: str):
    return Window.partitionBy(PART).orderBy(order)


def running_sum(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    df = in_ranges(df.withColumn("__v", value.cast("double")), order)
    totals = df.groupBy(PART).agg(F.sum("__v").alias("__t"))
    w = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(PART, F.coalesce(F.sum("__t").over(w), F.lit(0.0)).alias("__b"))
    own = F.coalesce(F.sum("__v").over(_window(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return df.withColumn(name, own).join(F.broadcast(before), PART, "left").withColumn(name, F.col(name) + F.col("__b")).drop("__v", "__b", PART)


def running_last(df: DataFrame, order: str, value: Column, name: str, how: str = "last") -> DataFrame:
    """The last value that is not null up to each row; how: last, max or min."""
    df = in_ranges(df.withColumn("__v", value), order)
    pick = {"last": lambda c, w: F.last(c, ignorenulls=True).over(w), "max": lambda c, w: F.max(c).over(w), "min": lambda c, w: F.min(c).over(w)}[how]
    tails = df.groupBy(PART).agg((F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(order))) if how == "last" else getattr(F, how)("__v")).alias("__t"))
    before = tails.select(PART, pick("__t", Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)).alias("__b"))
    own = pick("__v", _window(order).rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn(name, own).join(F.broadcast(before), PART, "left")
    both = {"last": F.coalesce(name, "__b"), "max": F.greatest(name, "__b"), "min": F.least(name, "__b")}[how]
    return out.withColumn(name, both).drop("__v", "__b", PART)


def lag(df: DataFrame, order: str, value: Column, n: int, name: str) -> DataFrame:
    """The value n rows before; null for the first n."""
    df = in_ranges(df.withColumn("__v", F.struct(value.alias("v"))), order)
    last = F.row_number().over(Window.partitionBy(PART).orderBy(F.col(order).desc()))
    # the n last rows before each range, from however many ranges they come
    tails = df.select(PART, order, "__v", last.alias("__k")).filter(F.col("__k") <= n)
    known = tails.groupBy(PART).agg(F.array_sort(F.collect_list(F.struct(order, "__v"))).alias("__l"))
    w = Window.orderBy(PART).rowsBetween(-n, -1)
    before = known.select(PART, F.flatten(F.collect_list("__l").over(w)).alias("__b"))
    k = F.row_number().over(_window(order))
    own = F.lag("__v", n).over(_window(order))
    out = df.withColumn("__k", k).withColumn("__own", own).join(F.broadcast(before), PART, "left")
    size = F.size("__b")
    at = size - n + F.col("__k") - 1
    return out.withColumn(name, F.when(F.col("__k") > n, F.col("__own.v")).when(at >= 0, F.get("__b", at)["__v"]["v"])).drop("__v", "__k", "__own", "__b", PART)

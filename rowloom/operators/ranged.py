"""Running sums over many ordered values of one group, without gathering them in one task.

Values are dealt to ranges by fixed splitters, so that every use of a row finds it in the same range and nothing needs to be kept. A window
runs inside of a range; the sums of the ranges before it are one row for each group and range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "__rid"


def splitters(df: DataFrame, order: str, most: int = 256) -> list[float]:
    """Quantiles of a column by a sketch: as many as there are shuffle partitions, ``most`` at most."""
    n = min(most, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    return sorted(set(found or []))


def range_of(order: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda s: s <= order.cast("double"))) if cuts else F.lit(0)


def running_sums(df: DataFrame, by: list[str], order: str, sums: dict[str, Column], cuts: list[float], down: bool = False, own: bool = True) -> DataFrame:
    """df and for each name of ``sums`` the sum up to each row in the group's order (``down``: from the greatest on), without the row itself if not ``own``. Rows of a group differ in ``order``."""
    df = df.withColumns({RANGE: range_of(F.col(order), cuts), **{f"__v_{n}": c for n, c in sums.items()}})
    totals = df.groupBy(*by, RANGE).agg(*(F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums))
    way = lambda c: F.desc(c) if down else F.asc(c)
    before = Window.partitionBy(*by).orderBy(way(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*(F.col(c).alias(f"__k_{c}") for c in [*by, RANGE]), *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums))
    inside = Window.partitionBy(*by, RANGE).orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    out = df.withColumns({n: F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in sums})
    out = out.join(before, reduce(lambda a, b: a & b, (out[c].eqNullSafe(before[f"__k_{c}"]) for c in [*by, RANGE])))
    return out.withColumns({n: F.col(n) + F.col(f"__b_{n}") for n in sums}).drop(RANGE, *(f"__k_{c}" for c in [*by, RANGE]), *(f"__{k}_{n}" for n in sums for k in "vb"))

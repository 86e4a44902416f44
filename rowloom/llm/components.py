"""Connected components of a large set of links, without gathering any of it.

Large-star and small-star steps (each a join and a minimum by key) until the links no longer change; every step is
written to the shared folder. The minimum of a hot node's neighbours is taken before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _star(links: DataFrame, small: bool) -> DataFrame:
    both = links if small else links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # small: links run from the larger to the smaller end
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if small:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    else:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, most_steps: int = 60) -> DataFrame:
    """links: a, b (long). Returns node, root for each node with a link: the smallest node that it reaches."""
    now = store(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(most_steps):
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = mark
        if not mark[0]:
            continue
        now = store(_star(_star(now, False), True), "links")
    raise RuntimeError(f"components did not settle in {most_steps} steps")

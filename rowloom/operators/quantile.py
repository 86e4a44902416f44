"""Exact percentiles without a group's values in one buffer.

A sketch of bounded size gives two bounds for each percentile of a large group, between which its ranks lie. The bounds are
sent to the rows, as there are few large groups: rows that met them in a shuffle would come to one task for each group. Then one
aggregate counts, for each group, the values between two bounds (one row for each different value) and those in each gap (one
row, with their least and greatest). A small group has no bounds and a row for each different value. Only these rows are put in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's ranks are right to one in so many rows; the bounds are three times as far to either side.
ACCURACY = 10_000
#: Groups of fewer values have no bounds.
LARGE = 100_000


def same_group(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """a joined to b's other columns by equal group values, missing ones included."""
    if not by:
        return a.crossJoin(F.broadcast(b))  # one row is sent
    other = b.withColumnsRenamed({c: f"__of_{c}" for c in by})
    return a.join(other, reduce(lambda x, y: x & y, (a[c].eqNullSafe(other[f"__of_{c}"]) for c in by)), how).drop(*(f"__of_{c}" for c in by))


def percentiles(df: DataFrame, by: list[str], wanted: list[tuple[str, str, float]]) -> DataFrame:
    """by and one column for each of wanted (name, variable, p from 0 to 1): linear between the ranks around p (n - 1). Groups without a value have no row."""
    variables = list(dict.fromkeys(v for _, v, _ in wanted))
    points = {v: sorted({p for _, x, p in wanted if x == v}) for v in variables}
    far = 3 / ACCURACY
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("__var"), F.col(v).cast("double").alias("__x")) for k, v in enumerate(variables))))
    long = df.select(*by, rows.alias("__r")).select(*by, "__r.*").filter("__x is not null")
    edges = {k: [e for p in points[v] for e in (max(0.0, p - far), min(1.0, p + far))] for k, v in enumerate(variables)}
    bounds = long.groupBy(*by, "__var").agg(F.count(F.lit(1)).alias("__n"), *(F.percentile_approx(F.when(F.col("__var") == k, F.col("__x")), e, ACCURACY).alias(f"__e{k}") for k, e in edges.items()))
    bounds = bounds.select(*by, "__var", "__n", F.coalesce(*(F.col(f"__e{k}") for k in edges)).alias("__edges"))
    met = same_group(long, F.broadcast(bounds.filter(F.col("__n") >= LARGE).drop("__n")), [*by, "__var"], "left")
    x, some = F.col("__x"), F.col("__edges").isNotNull()
    edge = [F.get("__edges", F.lit(j)) for j in range(max(map(len, edges.values())))]
    cell = F.when(some, reduce(lambda a, b: a + b, (F.when(e < x, 1).otherwise(0) for e in edge))).otherwise(0)
    gap = some & ~reduce(lambda a, b: a | b, (F.coalesce((x >= low) & (x <= high), F.lit(False)) for low, high in zip(edge[::2], edge[1::2], strict=True)))
    counted = met.select(*by, "__var", "__x", cell.alias("__cell"), F.when(~gap, x).alias("__at"))
    counted = counted.groupBy(*by, "__var", "__cell", "__at").agg(F.count(F.lit(1)).alias("__c"), F.min("__x").alias("__least"), F.max("__x").alias("__most"))
    group = Window.partitionBy(*by, "__var")
    w = group.orderBy("__cell", F.asc_nulls_first("__at")).rowsBetween(Window.unboundedPreceding, -1)  # a gap's values are below the bound that ends its cell
    ranked = counted.withColumns({"__before": F.coalesce(F.sum("__c").over(w), F.lit(0)), "__n": F.sum("__c").over(group)})
    last = F.col("__before") + F.col("__c") - 1
    asked = reduce(lambda c, k: c.when(F.col("__var") == k, F.array(*(F.struct(F.lit(i).alias("__i"), F.lit(p).alias("__p")) for i, p in enumerate(points[variables[k]])))), edges, F)
    rank = lambda q: q["__p"] * (F.col("__n") - 1)
    ranked = ranked.withColumn("__q", F.explode(F.filter(asked, lambda q: (F.floor(rank(q)) <= last) & (F.ceil(rank(q)) >= F.col("__before")))))
    ranked = ranked.withColumns({"__i": F.col("__q.__i"), "__rank": rank(F.col("__q"))})

    def value(rank):
        """Of the row that holds a rank; inside of a gap only its ends are known."""
        known = F.when(F.col("__at").isNotNull() | (F.col("__least") == F.col("__most")) | (rank == F.col("__before")), F.col("__least")).when(rank == last, F.col("__most"))
        return F.max(F.when((F.col("__before") <= rank) & (rank <= last), known.otherwise(F.raise_error(F.lit("a percentile lies outside of its bounds")).cast("double"))))

    picked = ranked.groupBy(*by, "__var", "__i").agg(value(F.floor("__rank")).alias("__a"), value(F.ceil("__rank")).alias("__b"), F.max(F.col("__rank") - F.floor("__rank")).alias("__f"))
    result = F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f")
    chosen = [F.max(F.when((F.col("__var") == variables.index(v)) & (F.col("__i") == points[v].index(q)), result)).alias(name) for name, v, q in wanted]
    return picked.groupBy(*by).agg(*chosen) if by else picked.agg(*chosen)

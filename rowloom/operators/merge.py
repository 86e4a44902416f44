"""Match-merge, update, interleaving and positional reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBS = "__obs__"


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def match_merge(inputs: list[DataFrame], by: list[str], flags: list[str | None]) -> DataFrame:
    """Rows of equal keys side by side, in order; a shorter input repeats its last row; later inputs overwrite.

    Each input has the BY columns and an OBS column, of any type that has an order. flags: names of 0/1 columns that tell an input's part in a key.
    All inputs' rows are dealt by key once; numbering, pairing and filling stay inside of these partitions.
    """
    tall = None
    for i, df in enumerate(inputs):
        own = F.struct(F.lit(i).alias("__i"), *(c for c in df.columns if c not in (*by, OBS)))
        df = df.select(*by, F.col(OBS).alias(f"__o{i}"), F.lit(i).alias("__src"), own.alias(f"__s{i}"))
        tall = df if tall is None else tall.unionByName(df, allowMissingColumns=True)
    number = F.row_number().over(Window.partitionBy(*by, "__src").orderBy(*(f"__o{i}" for i in range(len(inputs)))))
    tall = tall.repartition(*by).withColumn("__row", number)
    wide = tall.groupBy(*by, "__row").agg(*(F.first(f"__s{i}", ignorenulls=True).alias(f"__s{i}") for i in range(len(inputs))))
    running = Window.partitionBy(*by).orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    for i in range(len(inputs)):
        wide = wide.withColumn(f"__s{i}", F.last(f"__s{i}", ignorenulls=True).over(running))
    columns: dict[str, list[int]] = {}
    for i, df in enumerate(inputs):
        for c in df.columns:
            if c not in (*by, OBS):
                columns.setdefault(next((k for k in columns if k.lower() == c.lower()), c), []).append(i)
    out = []
    for c, sources in columns.items():
        value = None  # the latest input that has this key decides, even with a missing value
        for i in sources:
            name = next(x for x in inputs[i].columns if x.lower() == c.lower())
            v = F.when(F.col(f"__s{i}").isNotNull(), F.struct(F.col(f"__s{i}.{name}").alias("v")))
            value = v if value is None else F.coalesce(v, value)
        out.append(value["v"].alias(c))
    marks = [F.col(f"__s{i}").isNotNull().cast("int").alias(f) for i, f in enumerate(flags) if f]
    return wide.select(*by, "__row", *out, *marks)


def update_master(master: DataFrame, trans: DataFrame, by: list[str]) -> DataFrame:
    """Transactions in order lay their values that are not missing over the master's; new keys are added."""
    own = [c for c in trans.columns if c not in (*by, OBS)]
    folded = trans.groupBy(*by).agg(*(F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(OBS))).alias(f"__t_{c}") for c in own), F.lit(1).alias("__has"))
    m = master.alias("m")
    joined = m.join(folded.alias("t"), reduce(lambda x, y: x & y, (F.col(f"m.{k}").eqNullSafe(F.col(f"t.{k}")) for k in by)), "full")
    first = F.row_number().over(Window.partitionBy(*(F.col(k) for k in by)).orderBy(OBS))
    low = {c.lower(): c for c in master.columns}
    cols = [F.coalesce(F.when(F.col(f"m.{OBS}").isNull(), F.col(f"t.{k}")), F.col(f"m.{k}")).alias(k) for k in by]
    for c in master.columns:
        if c in by:
            continue
        t = next((x for x in own if x.lower() == c.lower()), None)
        cols.append((F.coalesce(F.when(F.col("__first") == 1, F.col(f"t.__t_{t}")), F.col(f"m.{c}")) if t else F.col(f"m.{c}")).alias(c))
    cols += [F.col(f"t.__t_{c}").alias(c) for c in own if c.lower() not in low]
    ranked = joined.withColumn("__first", F.when(F.col(f"m.{OBS}").isNull(), F.lit(1)).otherwise(F.row_number().over(Window.partitionBy(*(F.col(f"m.{k}") for k in by)).orderBy(F.col(f"m.{OBS}")))))
    del first
    return ranked.select(*cols)


def stack(inputs: list[DataFrame], flags: list[str | None]) -> DataFrame:
    """One input after the other; columns by name. The order is (__src, OBS)."""
    out = None
    names = [f for f in flags if f]
    for i, df in enumerate(inputs):
        df = df.withColumn("__src", F.lit(i)).withColumns({f: F.lit(int(flags[i] == f)) for f in names})
        if out is not None:  # one column, whatever its case
            low = {c.lower(): c for c in out.columns}
            df = df.withColumnsRenamed({c: low[c.lower()] for c in df.columns if c.lower() in low and low[c.lower()] != c})
            types = {f.name: f.dataType for f in out.schema.fields}
            df = df.withColumns({c: F.col(c).cast(types[c]) for c in df.columns if c in types and types[c].simpleString() == "string" and df.schema[c].dataType != types[c]})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def zip_rows(inputs: list[DataFrame], longest: bool) -> DataFrame:
    """Row k of each input side by side (inputs have a ``__k`` from 1); later inputs overwrite. Up to the shortest, or the longest."""
    out = inputs[0]
    for df in inputs[1:]:
        low = {c.lower(): c for c in out.columns}
        shared = {c: low[c.lower()] for c in df.columns if c.lower() in low and c not in ("__k", OBS)}
        b = df.drop(OBS).withColumnsRenamed({c: f"__b_{c}" for c in df.columns if c in shared}).withColumn("__hasb", F.lit(True))
        joined = out.join(b, "__k", "full" if longest else "inner")
        for c, mine in shared.items():
            joined = joined.withColumn(mine, F.when(F.col("__hasb"), F.col(f"__b_{c}")).otherwise(F.col(mine))).drop(f"__b_{c}")
        out = joined.drop("__hasb")
    return out

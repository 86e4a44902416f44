"""Sorting without duplicates, transposition, comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBS = "__obs__"


def sort_keys(df: DataFrame, keys: list[tuple[str, bool]]) -> list:
    return [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in keys]


def total_order(df: DataFrame, keys: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """The keys, then all other columns: ties have a fixed order."""
    named = {c for c, _ in keys}
    return [*keys, *[(c, False) for c in df.columns if c not in named and c != OBS and not isinstance(df.schema[c].dataType, T.MapType)]]


def first_per_key(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """The first row of each key in the total order: one minimum by key, so duplicates shrink before the shuffle.

    ``min`` over a struct sorts missing first and ascending, as the rest of the order does.
    """
    named = [c for c, _ in keys]
    rest = [c for c in df.columns if c not in named and c != OBS]
    if not rest:
        return df.select(*named).distinct()
    return df.groupBy(*named).agg(F.min(F.struct(*rest)).alias("__r")).select(*named, "__r.*").select(*[c for c in df.columns if c != OBS])


def transpose(df: DataFrame, by: list[str], variables: list[str], id_: str | None = None, prefix: str = "", name: str = "_NAME_", label: str | None = None, labels: dict | None = None, order: list | None = None, ids: list | None = None, most: int = 10_000) -> DataFrame:
    """Rows of ``variables`` become columns named by the id's values (or by their number). The last of equal ids wins.

    The columns' names must be known to plan: without ``ids`` they are collected, which is as many as the result has columns; more than ``most`` are refused.
    """
    order = order or [OBS]
    if id_:
        key = F.concat(F.lit(prefix), F.col(id_).cast("string"))
    else:
        w = Window.partitionBy(*by).orderBy(*order)
        key = F.concat(F.lit(prefix or "COL"), F.row_number().over(w).cast("string"))
    kept = df.select(*by, *[c for c in order if c not in by], key.alias("__id"), *[v for v in variables])
    if ids is None:
        found = kept.select("__id").distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"a transposed table would have more than {most} columns")
        ids = sorted((r[0] for r in found if r[0] is not None), key=lambda t: (len(t), t) if not id_ else (0, t))
    is_char = any(isinstance(df.schema[v].dataType, T.StringType) for v in variables)
    kind = "string" if is_char else "double"
    long = kept.select(*by, *[c for c in order if c not in by], "__id", F.explode(F.array(*(F.struct(F.lit(i).alias("__v"), F.lit(v).alias(name), *([F.lit((labels or {}).get(v.lower(), v)).alias(label)] if label else []), F.col(v).cast(kind).alias("__x")) for i, v in enumerate(variables)))).alias("__s"))
    long = long.select(*by, *[c for c in order if c not in by], "__id", "__s.*")
    at = F.struct(*order)
    wide = long.groupBy(*by, "__v", name, *([label] if label else [])).pivot("__id", ids).agg(F.max_by("__x", at))
    return wide.withColumnRenamed("__v", OBS)


def compare(base: DataFrame, other: DataFrame, ids: list[str], variables: list[str], tolerance: float = 1e-12) -> DataFrame:
    """_VAR_, ids, _BASE_, _COMPARE_ (as text) for each value that differs between rows of equal ids."""
    a, b = base.alias("a"), other.alias("b")
    joined = a.join(b, reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ids)))
    rows = []
    for v in variables:
        x, y = F.col(f"a.{v}"), F.col(f"b.{v}")
        same = x.eqNullSafe(y)
        if isinstance(base.schema[v].dataType, T.NumericType):
            same = same | F.coalesce(F.abs(x.cast("double") - y.cast("double")) <= tolerance, F.lit(False))
        rows.append(F.when(~same, F.struct(F.lit(v).alias("_VAR_"), x.cast("string").alias("_BASE_"), y.cast("string").alias("_COMPARE_"))))
    return joined.select(*(F.col(f"a.{k}").alias(k) for k in ids), F.explode(F.array_compact(F.array(*rows))).alias("__d")).select("__d._VAR_", *ids, "__d._BASE_", "__d._COMPARE_")

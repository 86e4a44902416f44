"""Datasets: a lazy DataFrame, its order, and what is known of its variables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBS = "__obs__"


@dataclass
class Variable:
    """What a variable has beside its values."""

    label: str | None = None
    format: str | None = None
    informat: str | None = None
    length: int | None = None


@dataclass
class Dataset:
    """``order``: columns (name, descending) that the observations are sorted by, the hidden OBS column last if there is one."""

    df: DataFrame
    variables: dict[str, Variable] = field(default_factory=dict)
    order: list[tuple[str, bool]] = field(default_factory=list)
    sort_keys: list[tuple[str, bool]] = field(default_factory=list)
    label: str | None = None

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != OBS]

    @property
    def visible(self) -> DataFrame:
        return self.df.drop(OBS)

    @property
    def ordered(self) -> DataFrame:
        """Without the hidden column, in order."""
        keys = self.order or ([(OBS, False)] if OBS in self.df.columns else [])
        df = self.df.orderBy(*(F.col(c).desc() if d else F.col(c).asc() for c, d in keys)) if keys else self.df
        return df.drop(OBS)

    def var(self, name: str) -> Variable:
        return self.variables.setdefault(name.lower(), Variable())


def load(df: DataFrame) -> DataFrame:
    """NaN becomes missing."""
    bad = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in bad}) if bad else df


def with_obs(d: Dataset) -> Dataset:
    """The dataset with an OBS column of increasing numbers, in its order.

    A dataset with a total order of its own is numbered by range: partitions by the order, counts of the partitions
    before it (one small row for each), and a row number inside. A dataset that has none keeps the order of its
    files and rows.
    """
    if OBS in d.df.columns:
        return d
    if not d.order:
        return Dataset(d.df.withColumn(OBS, F.monotonically_increasing_id()), d.variables, [(OBS, False)], d.sort_keys, d.label)
    return Dataset(number(d.df, d.order, OBS), d.variables, [(OBS, False)], d.sort_keys, d.label)


def with_place(d: Dataset) -> DataFrame:
    """The rows with an OBS column that only orders them: the columns that the dataset is in order of, if these ascend. Nothing is numbered."""
    if OBS not in d.df.columns and d.order and not any(desc for _, desc in d.order):
        return d.df.withColumn(OBS, F.struct(*(F.col(c).alias(f"k{i}") for i, (c, _) in enumerate(d.order))))
    return with_obs(d).df


def number(df: DataFrame, keys: list[tuple[str, bool]], name: str) -> DataFrame:
    """Row numbers from 1 in the order of the keys, without gathering all rows in one task."""
    cols = [F.col(c).desc() if d else F.col(c).asc() for c, d in keys]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    dealt = dealt.persist()  # both uses below must see the same partitions
    # inside a partition the ids count up from its number shifted by 33 bits
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))  # one row for each task
    return dealt.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__at", "__before")

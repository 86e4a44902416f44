"""Descriptive statistics and frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantile import percentiles, same_group

STATISTICS = ("n", "nmiss", "mean", "sum", "min", "max", "std", "var", "stderr", "range", "median", "q1", "q3", "p1", "p5", "p10", "p25", "p50", "p75", "p90", "p95", "p99", "cv", "css", "uss", "skewness", "kurtosis")


_POINTS = {"median": 0.5, "q1": 0.25, "q3": 0.75}
_SAME = {"p25": "q1", "p50": "median", "p75": "q3", "stddev": "std", "avg": "mean"}


def point(name: str) -> float | None:
    """Which percentile a statistic is, from 0 to 1; None: another statistic."""
    name = _SAME.get(name, name)
    return int(name[1:]) / 100 if name[0] == "p" and name[1:].isdigit() else _POINTS.get(name)


def statistic(name: str, x: Column) -> Column:
    """An aggregate by its name (no percentile); x is a double."""
    n = F.count(x).cast("double")
    made = {
        "n": lambda: F.count(x),
        "nmiss": lambda: F.sum(x.isNull().cast("long")),
        "mean": lambda: F.avg(x),
        "sum": lambda: F.sum(x),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "std": lambda: F.stddev_samp(x),
        "var": lambda: F.var_samp(x),
        "stderr": lambda: F.stddev_samp(x) / F.sqrt(n),
        "range": lambda: F.max(x) - F.min(x),
        "cv": lambda: F.try_divide(100 * F.stddev_samp(x), F.avg(x)),
        "css": lambda: F.var_pop(x) * n,
        "uss": lambda: F.sum(x * x),
        # Spark's are those of the population
        "skewness": lambda: F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)),
        "kurtosis": lambda: F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3))),
    }
    return made[_SAME.get(name, name)]()


def means(df: DataFrame, by: list[str], outputs: list[tuple[str, str, str]]) -> DataFrame:
    """One row for each combination of by values (missing ones are values too); outputs: (statistic, variable, name)."""
    aggs = [statistic(s, F.col(v).cast("double")).alias(n) for s, v, n in outputs if s != "qrange" and point(s) is None]
    wanted = [(n, v, point(s)) for s, v, n in outputs if point(s) is not None]
    wanted += [(f"__{q}_{n}", v, q / 100) for s, v, n in outputs if s == "qrange" for q in (25, 75)]
    plain = df.groupBy(*by).agg(*(aggs or [F.count(F.lit(1)).alias("__n")])) if by else df.agg(*(aggs or [F.count(F.lit(1)).alias("__n")]))
    if not wanted:
        return plain
    whole = same_group(plain, percentiles(df, by, wanted), by, "left")
    return whole.select(*by, *((F.col(f"__75_{n}") - F.col(f"__25_{n}")).alias(n) if s == "qrange" else F.col(n) for s, _, n in outputs))


def means_long(df: DataFrame, by: list[str], variables: list[str], stats: list[str]) -> DataFrame:
    """A row for each group and variable, with its statistics."""
    flat = means(df, by, [(s, v, f"{v}|{s}") for v in variables for s in stats])
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), *(F.col(f"`{v}|{s}`").cast("double").alias(s) for s in stats)) for v in variables)))
    return flat.select(*by, rows.alias("__r")).select(*by, "__r.*")


def freq_one(df: DataFrame, var: str, missing: bool = False, weight: str | None = None) -> DataFrame:
    """value, COUNT, PERCENT, CUM_FREQ, CUM_PCT, in order of the values."""
    df = df if missing else df.filter(F.col(var).isNotNull())
    counts = df.groupBy(var).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("COUNT"))
    total = Window.partitionBy()  # over one row for each value
    running = Window.orderBy(F.col(var).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(var, "COUNT", (100 * F.col("COUNT") / F.sum("COUNT").over(total)).alias("PERCENT"), F.sum("COUNT").over(running).alias("CUM_FREQ"), (100 * F.sum("COUNT").over(running) / F.sum("COUNT").over(total)).alias("CUM_PCT"))


def freq_out(df: DataFrame, variables: list[str], missing: bool = False, weight: str | None = None) -> DataFrame:
    """The combinations that occur, with COUNT and PERCENT."""
    for v in variables if not missing else []:
        df = df.filter(F.col(v).isNotNull())
    counts = df.groupBy(*variables).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("COUNT"))
    return counts.withColumn("PERCENT", 100 * F.col("COUNT") / F.sum("COUNT").over(Window.partitionBy()))


def freq_two(df: DataFrame, row: str, col: str, missing: bool = False) -> DataFrame:
    """Cells with COUNT, PERCENT, ROW_PCT and COL_PCT."""
    cells = freq_out(df, [row, col], missing)
    by = lambda c: F.sum("COUNT").over(Window.partitionBy(c))
    return cells.withColumns({"ROW_PCT": 100 * F.col("COUNT") / by(row), "COL_PCT": 100 * F.col("COUNT") / by(col)})


def chi_square(cells: DataFrame, row: str, col: str) -> DataFrame:
    """statistic and df of a table of cells (COUNT), zero cells included."""
    r = cells.groupBy(row).agg(F.sum("COUNT").alias("r"))
    c = cells.groupBy(col).agg(F.sum("COUNT").alias("c"))
    t = cells.agg(F.sum("COUNT").alias("t"), F.countDistinct(row).alias("nr"), F.countDistinct(col).alias("nc"))
    seen = cells.join(r, row).join(c, col).crossJoin(F.broadcast(t))  # one row is sent
    expected = F.col("r") * F.col("c") / F.col("t")
    # empty cells add their expectation: all expectations sum to the total
    return seen.agg((F.sum((F.col("COUNT") - expected) ** 2 / expected - expected) + F.first("t")).alias("statistic"), ((F.first("nr") - 1) * (F.first("nc") - 1)).alias("df"))


UNIVARIATE = ("n", "nmiss", "mean", "std", "var", "sum", "min", "max", "range", "skewness", "kurtosis", "p1", "p5", "p10", "q1", "median", "q3", "p90", "p95", "p99")


def univariate(df: DataFrame, by: list[str], variables: list[str]) -> DataFrame:
    return means_long(df, by, variables, list(UNIVARIATE))


def extremes(df: DataFrame, var: str, k: int = 5) -> DataFrame:
    """The k lowest and highest values with their rank: a top-k, not a sort."""
    low = df.filter(F.col(var).isNotNull()).select(F.col(var).alias("value"))
    a = low.orderBy("value").limit(k).withColumn("side", F.lit("low"))
    b = low.orderBy(F.desc("value")).limit(k).withColumn("side", F.lit("high"))
    return a.union(b)

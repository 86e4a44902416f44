"""Statistical models: the data is reduced to small sums in Spark, the algebra on these runs in numpy on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranged import range_of, running_sums, splitters
from .special import chi_quantile, probchi, probf, probnorm, probt, t_quantile


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns)))


# correlation


def pearson(df: DataFrame, variables: list[str]) -> DataFrame:
    """variable, with, r, n over rows without a missing value: one pass for all pairs."""
    whole = _complete(df, variables)
    pairs = [(a, b) for a in variables for b in variables]
    row = whole.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)), F.count(F.lit(1)).alias("n"))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("variable"), F.lit(b).alias("with"), F.col(f"{i}").alias("r"), F.col("n").alias("n")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def spearman(df: DataFrame, variables: list[str]) -> DataFrame:
    """As pearson, on mid-ranks. Ranks come from counts by value, so ties shrink before the one ordered pass over distinct values."""
    whole = _complete(df, variables)
    for v in variables:
        counts = whole.groupBy(v).agg(F.count(F.lit(1)).alias("__n"))
        counts = running_sums(counts, [], v, {"__before": F.col("__n")}, splitters(counts, v), own=False)
        ranks = counts.select(F.col(v).alias("__v"), (F.col("__before") + (F.col("__n") + 1) / 2).alias(f"__rank_{v}"))
        whole = whole.join(ranks, whole[v] == ranks["__v"]).drop("__v")
    renamed = whole.select(*(F.col(f"__rank_{v}").alias(v) for v in variables))
    return pearson(renamed, variables)


def signed_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The sum over pairs of different (x, y) cells of n n' sign(x - x') sign(y - y'), by halves of the order of x."""
    order = np.lexsort((y, x))
    x, y, n = x[order], y[order], n[order].astype(float)

    def inside(a: int, z: int) -> float:
        """As if all x differed."""
        if z - a <= 64:
            return float((np.triu(np.sign(y[None, a:z] - y[a:z, None]), 1) * n[a:z, None] * n[None, a:z]).sum())
        m = (a + z) // 2
        left = np.argsort(y[a:m], kind="stable") + a
        below = np.concatenate([[0.0], np.cumsum(n[left])])
        less = below[np.searchsorted(y[left], y[m:z], "left")]
        more = below[-1] - below[np.searchsorted(y[left], y[m:z], "right")]
        return inside(a, m) + inside(m, z) + float((n[m:z] * (less - more)).sum())

    # cells of one x were counted as rising, as they are in order of y
    begins = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, int)
    if not len(begins):
        return 0.0
    same = np.add.reduceat(n, begins) ** 2 - np.add.reduceat(n * n, begins)
    return inside(0, len(x)) - float(same.sum()) / 2


def kendall(df: DataFrame, x: str, y: str) -> float:
    """tau-b, exactly. Distinct (x, y) cells are dealt to ranges of x and of y; pairs in different ranges of both are counted from the grid of ranges
    (a bounded number of cells), pairs that share a range inside of it, one task for each range."""
    cells = _complete(df, [x, y]).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumns({"i": range_of(F.col("x"), splitters(cells, "x", 128)), "j": range_of(F.col("y"), splitters(cells, "y", 128))})
    grid = cells.groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()  # 128 by 128 rows at most
    total = float(grid.n.sum())
    apart = 0.0
    if len(grid):
        g = np.zeros((grid.i.max() + 1, grid.j.max() + 1))
        g[grid.i, grid.j] = grid.n
        below = g.cumsum(0) - g  # in ranges of x before
        less, upto = below.cumsum(1) - below, below.cumsum(1)
        apart = float((g * (less - (below.sum(1, keepdims=True) - upto))).sum())

    def pairs(key: list[str]) -> float:
        def of(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"s": [signed_pairs(part.x.to_numpy(), part.y.to_numpy(), part.n.to_numpy())]})

        return float(cells.select("x", "y", "n", "i", "j").groupBy(*key).applyInPandas(of, "s double").agg(F.sum("s")).first()[0] or 0.0)

    s = apart + pairs(["i"]) + pairs(["j"]) - pairs(["i", "j"])
    tied = lambda c: float(cells.groupBy(c).agg(F.sum("n").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0.0)
    all_ = total * (total - 1) / 2
    both = (all_ - tied("x")) * (all_ - tied("y"))
    return s / math.sqrt(both) if both > 0 else float("nan")


# t tests


def t_one(df: DataFrame, var: str | Column, h0: float = 0.0) -> dict:
    x = (F.col(var) if isinstance(var, str) else var).cast("double")
    n, mean, sd = df.agg(F.count(x), F.avg(x), F.stddev_samp(x)).first()
    se = sd / math.sqrt(n)
    t = (mean - h0) / se
    q = t_quantile(0.975, n - 1)
    return {"n": n, "mean": mean, "std": sd, "stderr": se, "t": t, "df": n - 1, "p": 2 * (1 - probt(abs(t), n - 1)), "lower": mean - q * se, "upper": mean + q * se}


def t_two(df: DataFrame, var: str, group: str) -> dict:
    """Pooled and unequal variances."""
    x = F.col(var).cast("double")
    rows = df.filter(x.isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")).orderBy(group).limit(3).collect()
    if len(rows) != 2:
        raise ValueError("a two-sample test needs two groups")
    (_, n1, m1, v1), (_, n2, m2, v2) = rows
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
    t = (m1 - m2) / math.sqrt(pooled * (1 / n1 + 1 / n2))
    tw = (m1 - m2) / math.sqrt(v1 / n1 + v2 / n2)
    dfw = (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
    return {"n1": n1, "n2": n2, "mean1": m1, "mean2": m2, "diff": m1 - m2, "t": t, "df": n1 + n2 - 2, "p": 2 * (1 - probt(abs(t), n1 + n2 - 2)), "t_unequal": tw, "df_unequal": dfw, "p_unequal": 2 * (1 - probt(abs(tw), dfw))}


# least squares


def ols(df: DataFrame, y: str, xs: list[str], intercept: bool = True) -> dict:
    """One pass of sums of products, centred at the means for their precision; the normal equations are solved on the driver."""
    whole = _complete(df, [y, *xs])
    c = {v: F.col(v).cast("double") for v in [y, *xs]}
    n, *centre = whole.agg(F.count(F.lit(1)), *(F.avg(c[v]) for v in [y, *xs])).first()
    centre = np.array(centre, float) if intercept else np.zeros(len(xs) + 1)
    d = [c[v] - F.lit(float(m)) for v, m in zip([y, *xs], centre, strict=True)]
    idx = [(i, j) for i in range(len(d)) for j in range(i, len(d))]
    row = whole.agg(*(F.sum(d[i] * d[j]) for i, j in idx)).first()
    s = np.zeros((len(d), len(d)))
    for (i, j), v in zip(idx, row, strict=True):
        s[i, j] = s[j, i] = v or 0.0
    sxx, sxy, syy = s[1:, 1:], s[1:, 0], s[0, 0]
    inv = np.linalg.pinv(sxx)
    beta = inv @ sxy
    sse = float(syy - beta @ sxy)
    k = len(xs) + int(intercept)
    mse = sse / (n - k)
    cov = inv * mse
    names, est, se = list(xs), list(beta), list(np.sqrt(np.diag(cov)))
    if intercept:
        names = ["Intercept", *names]
        est = [centre[0] - centre[1:] @ beta, *est]
        se = [math.sqrt(mse / n + centre[1:] @ cov @ centre[1:]), *se]
    f = (syy - sse) / len(xs) / mse if mse > 0 else float("inf")
    return {
        "names": names, "estimate": np.array(est), "stderr": np.array(se), "t": np.array(est) / np.array(se), "p": np.array([2 * (1 - probt(abs(a / b), n - k)) for a, b in zip(est, se, strict=True)]),
        "n": n, "df": n - k, "sse": sse, "sst": float(syy), "mse": mse, "rsquare": 1 - sse / syy, "adjrsq": 1 - (1 - (1 - sse / syy)) * 1.0 if False else 1 - (sse / (n - k)) / (syy / (n - int(intercept))), "f": f, "pf": 1 - probf(f, len(xs), n - k), "rmse": math.sqrt(mse),
    }


def linear_predictor(names: list[str], estimate) -> Column:
    return reduce(lambda a, b: a + b, ((F.lit(float(e)) if n == "Intercept" else F.lit(float(e)) * F.col(n).cast("double")) for n, e in zip(names, estimate, strict=True)))


# logistic regression and other binomial models


def equal_rows(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Equal rows once with their number __w; kept, as all steps of all fits of a model pass over these."""
    return df.select(*(c.alias(n) for n, c in columns.items())).groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("__w")).persist()


def irls(df: DataFrame, y: Column, xs: list[tuple[str, Column]], steps: int = 25, start=None, offset: Column | None = None) -> dict:
    """Newton steps; each is one aggregate of the gradient's and the Hessian's sums. y is 0 or 1; xs are named columns, the intercept among them. df can be of equal_rows."""
    k = len(xs)
    beta = np.zeros(k) if start is None else np.array(start, float)
    columns = {"__y": y.cast("double"), **{f"__x{i}": x.cast("double") for i, (_, x) in enumerate(xs)}, "__o": offset if offset is not None else F.lit(0.0)}
    counted = "__w" in df.columns
    data = df.select(*(c.alias(n) for n, c in columns.items()), "__w") if counted else equal_rows(df, columns)
    loglik = None
    cov = np.eye(k)
    for _ in range(steps):
        eta = reduce(lambda a, b: a + b, (F.lit(float(b)) * F.col(f"__x{i}") for i, b in enumerate(beta)), F.col("__o"))
        p = F.try_divide(F.lit(1.0), 1 + F.exp(-eta))
        w = p * (1 - p) * F.col("__w")
        idx = [(i, j) for i in range(k) for j in range(i, k)]
        ll = F.sum(F.col("__w") * (F.col("__y") * eta - F.when(eta > 30, eta).otherwise(F.log1p(F.exp(eta)))))
        row = data.agg(*(F.sum((F.col("__y") - p) * F.col("__w") * F.col(f"__x{i}")) for i in range(k)), *(F.sum(w * F.col(f"__x{i}") * F.col(f"__x{j}")) for i, j in idx), ll, F.sum("__w")).first()
        g = np.array(row[:k], float)
        h = np.zeros((k, k))
        for (i, j), v in zip(idx, row[k:], strict=False):
            h[i, j] = h[j, i] = v
        cov = np.linalg.pinv(h)
        step = cov @ g
        new, n = row[k + len(idx)], row[k + len(idx) + 1]
        if loglik is not None and abs(new - loglik) < 1e-10 * (abs(loglik) + 1) and np.abs(step).max(initial=0) < 1e-9:
            break
        loglik = new
        beta = beta + step
    if not counted:
        data.unpersist()
    se = np.sqrt(np.diag(cov))
    z = beta / se
    return {"names": [n for n, _ in xs], "estimate": beta, "stderr": se, "cov": cov, "chisq": z * z, "p": np.array([2 * (1 - probnorm(abs(v))) for v in z]), "loglik": loglik, "n": n}


def profile_interval(fit, refit, xs, index: int, alpha: float = 0.05) -> tuple[float, float]:
    """Likelihood-ratio limits of one parameter: where the profile log-likelihood has fallen by half a chi-square quantile.

    ``refit`` gives the fit of the other columns, from a start, with an offset.
    """
    drop = chi_quantile(1 - alpha, 1) / 2
    others = [x for i, x in enumerate(xs) if i != index] or [("zero", F.lit(0.0))]
    start = [b for i, b in enumerate(fit["estimate"]) if i != index] or [0.0]

    def fall(value: float) -> float:
        return fit["loglik"] - refit(others, start, F.lit(float(value)) * xs[index][1].cast("double"))["loglik"]

    out = []
    for sign in (-1, 1):  # the root of the fall is almost a straight line from the estimate on
        far, seen = sign * math.sqrt(2 * drop) * fit["stderr"][index], []
        for _ in range(25):
            seen.append((far, math.sqrt(max(fall(fit["estimate"][index] + far), 0.0))))
            gap = [abs(y - math.sqrt(drop)) for _, y in seen[-2:]]
            if gap[-1] < 1e-8:
                break
            if len(gap) == 2 and gap[0] < 1e-5 and gap[1] > gap[0] / 4:  # hardly nearer: what is left is rounding in sums over many rows
                far = seen[-1 if gap[1] < gap[0] else -2][0]
                break
            (x0, y0), (x1, y1) = ([(0.0, 0.0), *seen])[-2:]
            far = x1 + (math.sqrt(drop) - y1) * (x1 - x0) / (y1 - y0) if y1 != y0 else 2 * x1
        out.append(fit["estimate"][index] + far)
    return out[0], out[1]


# survival


def kaplan_meier(df: DataFrame, time: str, event: Column, strata: list[str]) -> DataFrame:
    """strata, time, n_risk, n_event, n_censor, survival, stderr (Greenwood). Counts by time first; windows run over distinct times."""
    counts = df.filter(F.col(time).isNotNull()).groupBy(*strata, F.col(time).cast("double").alias("time")).agg(F.sum(event.cast("long")).alias("n_event"), F.sum((~event).cast("long")).alias("n_censor"))
    cuts = splitters(counts, "time")
    t = running_sums(counts, strata, "time", {"n_risk": F.col("n_event") + F.col("n_censor")}, cuts, down=True)
    d, n = F.col("n_event").cast("double"), F.col("n_risk").cast("double")
    sums = {"__log": F.when(d < n, F.log1p(-d / n)).otherwise(0.0), "__dead": (d == n).cast("int"), "__var": F.when(d < n, d / (n * (n - d))).otherwise(0.0)}
    t = running_sums(t, strata, "time", sums, cuts)
    t = t.withColumn("survival", F.when(F.col("__dead") > 0, 0.0).otherwise(F.exp("__log")))
    return t.withColumn("stderr", F.when(F.col("survival") > 0, F.col("survival") * F.sqrt("__var"))).select(*strata, "time", "n_risk", "n_event", "n_censor", "survival", "stderr")


def quartiles(km: DataFrame, strata: list[str]) -> DataFrame:
    """The first times at which survival is at or below 0.75, 0.5 and 0.25; the midpoint to the next where it stays at the value exactly."""
    parts = []
    w = Window.partitionBy(*strata).orderBy("time")
    ev = km.filter("n_event > 0").withColumn("next", F.lead("time").over(w))
    for pct, level in ((25, 0.75), (50, 0.5), (75, 0.25)):
        hit = F.when(F.col("survival") <= level + 1e-12, F.struct("time", "survival", "next"))
        m = F.min(hit)
        exact = F.abs(m["survival"] - level) < 1e-12
        parts.append(ev.groupBy(*strata).agg(F.lit(pct).alias("percent"), F.when(exact & m["next"].isNotNull(), (m["time"] + m["next"]) / 2).otherwise(m["time"]).alias("estimate")))
    return reduce(lambda a, b: a.union(b), parts)


def log_rank(df: DataFrame, time: str, event: Column, groups: list[str], strata: list[str] | None = None) -> dict:
    """k groups, possibly stratified. Counts by stratum, time and group; the k by k sums are taken over distinct times."""
    strata = strata or []
    g = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in groups))
    data = df.filter(F.col(time).isNotNull()).select(g.alias("g"), F.concat_ws("|", F.lit(""), *(F.col(c).cast("string") for c in strata)).alias("s"), F.col(time).cast("double").alias("t"), event.alias("e"))
    levels = [r[0] for r in data.select("g").distinct().orderBy("g").collect()]
    k = len(levels)
    per = data.groupBy("s", "t").agg(*(F.sum((F.col("g") == v).cast("double")).alias(f"n{i}") for i, v in enumerate(levels)), *(F.sum(((F.col("g") == v) & F.col("e")).cast("double")).alias(f"d{i}") for i, v in enumerate(levels)))
    per = running_sums(per, ["s"], "t", {f"r{i}": F.col(f"n{i}") for i in range(k)}, splitters(per, "t"), down=True)
    r = reduce(lambda a, b: a + b, (F.col(f"r{i}") for i in range(k)))
    d = reduce(lambda a, b: a + b, (F.col(f"d{i}") for i in range(k)))
    per = per.withColumns({"r": r, "d": d}).filter("d > 0")
    v = lambda i, j: F.sum(F.when(F.col("r") > 1, F.col("d") * (F.col("r") - F.col("d")) / (F.col("r") - 1) * F.col(f"r{i}") / F.col("r") * ((1.0 if i == j else 0.0) - F.col(f"r{j}") / F.col("r"))).otherwise(0.0))
    row = per.agg(*(F.sum(F.col(f"d{i}") - F.col("d") * F.col(f"r{i}") / F.col("r")) for i in range(k)), *(v(i, j) for i in range(k) for j in range(k))).first()
    o, cov = np.array(row[:k], float), np.array(row[k:], float).reshape(k, k)
    chi = float(o @ np.linalg.pinv(cov) @ o)
    return {"groups": levels, "oe": o, "chisq": chi, "df": k - 1, "p": 1 - probchi(chi, k - 1)}


@dataclass
class RiskRows:
    """The complete rows of a hazards model, equal ones once with their number: stratum s, time t, event e (0 or 1), columns x0, x1, ..., number __w."""

    df: DataFrame
    cuts: list[float]
    n: int
    events: float


def risk_rows(df: DataFrame, time: str, event: Column, xs: list[Column], strata: list[str] | None = None) -> RiskRows:
    of = {"s": F.concat_ws("|", F.lit(""), *(F.col(c).cast("string") for c in strata or [])), "t": F.col(time).cast("double"), "e": event.cast("double"), **{f"x{i}": x.cast("double") for i, x in enumerate(xs)}}
    whole = _complete(df.select(*(c.alias(n) for n, c in of.items())), ["t", "e", *(f"x{i}" for i in range(len(xs)))])
    rows = equal_rows(whole, {n: F.col(n) for n in of})
    n, events = rows.agg(F.sum("__w"), F.sum(F.col("__w") * F.col("e"))).first()
    return RiskRows(rows, splitters(rows, "t"), int(n or 0), events)


def cox(df: DataFrame, time: str, event: Column, xs: list[tuple[str, Column]], strata: list[str] | None = None, steps: int = 30, start=None, offset: Column | None = None) -> dict:
    """Proportional hazards with Efron's ties."""
    k = len(xs)
    rows = risk_rows(df, time, event, [x for _, x in xs] + ([offset] if offset is not None else []), strata)
    try:
        return cox_fit(rows, [(n, F.col(f"x{i}")) for i, (n, _) in enumerate(xs)], steps, start, F.col(f"x{k}") if offset is not None else None)
    finally:
        rows.df.unpersist()


def cox_fit(rows: RiskRows, xs: list[tuple[str, Column]], steps: int = 30, start=None, offset: Column | None = None) -> dict:
    """As cox, for columns of rows. Each Newton step sums over risk sets from the last time on: by time first, then running sums over ranges of the distinct times."""
    k = len(xs)
    data = rows.df.select("s", "t", "e", "__w", (offset if offset is not None else F.lit(0.0)).cast("double").alias("o"), *(x.cast("double").alias(f"x{i}") for i, (_, x) in enumerate(xs)))
    beta, loglik = np.zeros(k) if start is None else np.array(start, float), None
    idx = [(i, j) for i in range(k) for j in range(i, k)]
    cov = np.eye(k)
    for _ in range(steps):
        eta = reduce(lambda a, b: a + b, (F.lit(float(b)) * F.col(f"x{i}") for i, b in enumerate(beta)), F.col("o"))
        e, w = F.col("__w") * F.col("e"), F.col("__w") * F.exp(eta)
        sums = {"d": e, "le": e * eta, "w": w, "dw": F.col("e") * w}
        sums |= {f"ex{i}": e * F.col(f"x{i}") for i in range(k)} | {f"wx{i}": w * F.col(f"x{i}") for i in range(k)} | {f"dx{i}": F.col("e") * w * F.col(f"x{i}") for i in range(k)}
        sums |= {f"wx{i}_{j}": w * F.col(f"x{i}") * F.col(f"x{j}") for i, j in idx} | {f"dx{i}_{j}": F.col("e") * w * F.col(f"x{i}") * F.col(f"x{j}") for i, j in idx}
        per = data.groupBy("s", "t").agg(*(F.sum(v).alias(n) for n, v in sums.items()))  # equal times once
        risk = ["w", *(f"wx{i}" for i in range(k)), *(f"wx{i}_{j}" for i, j in idx)]
        per = running_sums(per, ["s"], "t", {f"r_{n}": F.col(n) for n in risk}, rows.cuts, down=True).filter("d > 0")
        # the l-th of d tied events sees the risk set less l/d of the tied ones
        per = per.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("d").cast("int") - 1))).withColumn("f", F.col("l") / F.col("d"))
        a = F.col("r_w") - F.col("f") * F.col("dw")
        b = [F.col(f"r_wx{i}") - F.col("f") * F.col(f"dx{i}") for i in range(k)]
        first = F.col("l") == 0
        ll = F.sum(F.when(first, F.col("le")).otherwise(0.0) - F.log(a))
        grad = [F.sum(F.when(first, F.col(f"ex{i}")).otherwise(0.0) - b[i] / a) for i in range(k)]
        hess = [F.sum((F.col(f"r_wx{i}_{j}") - F.col("f") * F.col(f"dx{i}_{j}")) / a - b[i] * b[j] / (a * a)) for i, j in idx]
        row = per.agg(ll, *grad, *hess).first()
        if row[0] is None:
            break
        g, h = np.array(row[1 : k + 1], float), np.zeros((k, k))
        for (i, j), v in zip(idx, row[k + 1 :], strict=True):
            h[i, j] = h[j, i] = v
        cov = np.linalg.pinv(h)
        step = cov @ g
        if np.abs(step).max() < 1e-9:
            loglik = row[0]
            break
        if np.abs(step).max() > 5:
            step *= 5 / np.abs(step).max()
        beta, loglik = beta + step, row[0]
    se = np.sqrt(np.diag(cov))
    z = beta / se
    return {"names": [n_ for n_, _ in xs], "estimate": beta, "stderr": se, "cov": cov, "chisq": z * z, "p": np.array([2 * (1 - probnorm(abs(v))) for v in z]), "hr": np.exp(beta), "lower": np.exp(beta - 1.959963984540054 * se), "upper": np.exp(beta + 1.959963984540054 * se), "loglik": loglik, "n": rows.n, "events": rows.events}


def levels(df: DataFrame, var: str, most: int = 500) -> list:
    """The values of a class variable, numbers before texts; bounded."""
    found = [r[0] for r in df.select(var).filter(F.col(var).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"class variable {var} has more than {most} levels")
    return sorted(found, key=lambda v: (isinstance(v, str), v))


def reference_level(values: list, wanted=None):
    if wanted is None or str(wanted).lower() == "last":
        return values[-1]
    if str(wanted).lower() == "first":
        return values[0]
    for v in values:
        if str(v) == str(wanted) or isinstance(v, (int, float)) and str(wanted).replace(".", "", 1).lstrip("-").isdigit() and float(v) == float(wanted):
            return v
    raise ValueError(f"no level {wanted}")


def dummies(df: DataFrame, var: str, ref=None) -> list[tuple[str, Column]]:
    """0/1 columns for all levels but the reference."""
    values = levels(df, var)
    base = reference_level(values, ref)
    text = lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return [(f"{var} {text(v)}", (F.col(var) == F.lit(v)).cast("double")) for v in values if v != base]

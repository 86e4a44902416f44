import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.stats import models


@pytest.mark.parametrize("noise", [0.0, 1e-6])
def test_profile_limits_end_at_the_rounding_of_the_sums(noise):
    r, asked = random.Random(3), []
    fit = {"loglik": 0.0, "estimate": [0.7], "stderr": [0.25]}

    def refit(others, start, offset):
        b = asked[-1]
        return {"loglik": -(((b - 0.7) / 0.25) ** 2) / 2 - 0.3 * (b - 0.7) ** 3 + r.uniform(-noise, noise)}

    class X:
        def cast(self, _):
            return self

        def __rmul__(self, value):
            return self

    lit = models.F.lit
    try:
        models.F.lit = lambda v: asked.append(v) or 1.0
        low, high = models.profile_interval(fit, refit, [("x", X())], 0)
    finally:
        models.F.lit = lit
    for b in (low, high):
        assert ((b - 0.7) / 0.25) ** 2 / 2 + 0.3 * (b - 0.7) ** 3 == pytest.approx(3.841458820694124 / 2, abs=1e-5)
    assert len(asked) < 26, "50 fits if rounding keeps the search from its end"


def test_equal_rows_count_in_cox(spark):
    r = random.Random(4)
    rows = [(float(r.randrange(6)), r.random() < 0.7, float(r.randrange(2)), r.choice("ab")) for _ in range(300)]
    df = spark.createDataFrame(rows, "t double, e boolean, x double, s string")
    kept = models.risk_rows(df, "t", F.col("e"), [F.col("x")], ["s"])
    assert kept.df.count() == len(set(rows)) and kept.n == 300 and kept.events == sum(e for _, e, _, _ in rows)

    def loglik(b):
        out = 0.0
        for s in "ab":
            t, e, x = (np.array(v) for v in zip(*((t, e, x) for t, e, x, g in rows if g == s), strict=True))
            for at in np.unique(t[e]):
                tied, risk = (t == at) & e, np.exp(b * x[t >= at]).sum()
                out += b * x[tied].sum() - sum(math.log(risk - k / tied.sum() * np.exp(b * x[tied]).sum()) for k in range(tied.sum()))
        return out

    for fit in (models.cox(df, "t", F.col("e"), [("x", F.col("x"))], ["s"]), models.cox_fit(kept, [("x", F.col("x0"))])):
        b = fit["estimate"][0]
        assert fit["loglik"] == pytest.approx(loglik(b), abs=1e-9) and fit["n"] == 300
        assert max(loglik(b - 1e-3), loglik(b + 1e-3)) < loglik(b)
    fixed = models.cox(df, "t", F.col("e"), [("zero", F.lit(0.0))], ["s"], offset=0.4 * F.col("x"))
    assert fixed["loglik"] == pytest.approx(loglik(0.4), abs=1e-9)


def test_equal_rows_count_in_binomial_fits(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(float(r.random() < 0.3 + 0.2 * g), float(g)) for g in range(3) for _ in range(100)], "y double, g double")
    xs = [("Intercept", F.lit(1.0)), ("g", F.col("g"))]
    one = models.irls(df, F.col("y"), xs)
    rows = models.equal_rows(df, {"__e": F.col("y"), "__c0": F.lit(1.0), "__c1": F.col("g")})
    two = models.irls(rows, F.col("__e"), [("Intercept", F.col("__c0")), ("g", F.col("__c1"))])
    assert rows.count() == 6 and two["n"] == one["n"] == 300 and np.allclose(one["estimate"], two["estimate"], atol=1e-10) and np.allclose(one["stderr"], two["stderr"])

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.operators import ranged
from rowloom.stats import models


@pytest.mark.parametrize("down", [False, True])
def test_running_sums(spark, down):
    r = random.Random(1)
    rows = [(g, float(k), r.randrange(9)) for g in ("a", None) for k in r.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "g string, x double, v int")
    for cuts in ([], ranged.splitters(df, "x"), [-5.0, 3.0, 3.5, 400.0, 2000.0]):
        for own in (True, False):
            got = {(x.g, x.x): x.s for x in ranged.running_sums(df, ["g"], "x", {"s": F.col("v")}, cuts, down, own).collect()}
            for g, x, v in rows:
                want = sum(w for h, y, w in rows if h == g and (y > x if down else y < x)) + (v if own else 0)
                assert got[g, x] == want


def _tau(rows):
    s = px = py = 0
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        s += np.sign(a - c) * np.sign(b - d)
        px += a != c
        py += b != d
    return s / np.sqrt(float(px) * float(py))


def test_kendall_of_continuous_and_tied_values(spark):
    r = random.Random(2)
    for draw in (lambda: r.gauss(0, 1), lambda: float(r.randrange(6))):
        rows = [(x := draw(), x * 0.5 + draw()) for _ in range(400)]
        assert models.kendall(spark.createDataFrame([*rows, (None, 1.0)], "x double, y double"), "x", "y") == pytest.approx(_tau(rows), abs=1e-12)
    x, y, n = (np.array([r.randrange(40) for _ in range(700)]) for _ in range(3))
    cells = {(a, b): 0 for a, b in zip(x, y, strict=True)}
    for a, b, c in zip(x, y, n, strict=True):
        cells[a, b] += c
    x, y, n = (np.array(v, float) for v in zip(*((a, b, c) for (a, b), c in cells.items()), strict=True))
    want = sum(n[i] * n[j] * np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i))
    assert models.signed_pairs(x, y, n) == want

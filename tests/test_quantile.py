import random

import numpy as np
import pytest

from rowloom.operators import quantile, summary


@pytest.mark.parametrize("many", [1, 40, 30_000])
def test_percentiles_are_exact(spark, many):
    r = random.Random(many)
    kinds = [lambda: r.gauss(0, 1), lambda: float(r.randrange(5)), lambda: None if r.random() < 0.2 else r.random()]
    rows = [(r.choice(["a", "b", None]) if many > 1 else "a", *(k() for k in kinds)) for _ in range(many)]
    rows.append(("empty", None, None, None))
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(3)
    points = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    wanted = [(f"{v}{p}", v, p) for v in "xyz" for p in points]
    for by in ([], ["g"]):
        got = {r.g if by else 0: r for r in quantile.percentiles(df, by, wanted).collect()}
        for g in {x[0] for x in rows} if by else [0]:
            for k, v in enumerate("xyz", 1):
                own = [x[k] for x in rows if (not by or x[0] == g) and x[k] is not None]
                for p in points:
                    found = got[g][f"{v}{p}"] if g in got else None
                    assert found is None if not own else np.isclose(found, np.percentile(own, 100 * p)), (g, v, p)


def test_means_with_percentiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), (None, 7.0), ("b", None)], "g string, x double")
    got = {r.g: r.asDict() for r in summary.means(df, ["g"], [("n", "x", "n"), ("median", "x", "m"), ("qrange", "x", "q"), ("p90", "x", "p")]).collect()}
    assert got["a"] == {"g": "a", "n": 3, "m": 2.0, "q": 1.5, "p": pytest.approx(3.6)}
    assert got[None]["m"] == 7.0 and got["b"] == {"g": "b", "n": 0, "m": None, "q": None, "p": None}
    assert summary.means(df.limit(0), [], [("median", "x", "m")]).collect()[0].m is None


@pytest.mark.parametrize("large", [0, 3_000, 10**9])
def test_percentiles_of_large_and_small_groups(spark, monkeypatch, large):
    monkeypatch.setattr(quantile, "LARGE", large)
    r = random.Random(large)
    rows = [(g, r.gauss(0, 1), float(r.randrange(3))) for g in ["a"] * 40_000 + [None] * 5_000 + ["c"] * 2_000 + ["d"]]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3)
    points = [0.0, 0.0001, 0.0002, 0.01, 0.5, 0.99, 1.0]  # bounds that overlap among them
    for by in ([], ["g"]):
        got = {x.g if by else 0: x for x in quantile.percentiles(df, by, [(f"{v}{k}", v, p) for v in "xy" for k, p in enumerate(points if v == "x" else points[3:])]).collect()}
        assert set(got) == ({"a", None, "c", "d"} if by else {0})
        for g, found in got.items():
            for at, v in enumerate("xy", 1):
                own = [x[at] for x in rows if not by or x[0] == g]
                for k, p in enumerate(points if v == "x" else points[3:]):
                    assert np.isclose(found[f"{v}{k}"], np.percentile(own, 100 * p)), (g, v, p)


def test_rows_of_a_large_group_stay_where_they_are(spark, monkeypatch):
    """No join may deal rows by their group: all of a column's would come to one task."""
    monkeypatch.setattr(quantile, "LARGE", 1_000, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for the planner to send
    df = spark.range(50_000).selectExpr("id % 2 as g", "cast(id as double) as x")
    try:
        plans = [quantile.percentiles(df, by, [("m", "x", 0.5)])._jdf.queryExecution().executedPlan().toString() for by in ([], ["g"])]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan

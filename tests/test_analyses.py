"""Analyses on series with gaps, groups without a name, and fits that have no SQL form."""

import datetime as dt
import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array  # noqa: F401
from pyspark.sql import functions as F

from gaugeboard.operators.analyses import anomaly, customers, customers as cust, descriptive as desc, regression, timeseries as ts


def _months(spark, missing, series=("a",), n=36):
    rows = []
    for s in series:
        for m in range(n):
            if m not in missing:
                rows.append((s, dt.date(2020 + m // 12, m % 12 + 1, 3), float(m)))
    return spark.createDataFrame(rows, "s string, day date, y double")


@pytest.mark.parametrize("fill", [0.0, None])
def test_gaps_are_filled(spark, fill):
    p = ts.periods(_months(spark, {4, 5, 20, 27, 30}, ("a", None)), "day", F.col("y"), series=["s"], fill=fill)
    for s in ("a", None):
        got = {r["t"]: r["y"] for r in p.where(F.col("s").eqNullSafe(F.lit(s))).collect()}
        assert got == {m: fill if m in (4, 5, 20, 27, 30) else float(m) for m in range(36)}


def test_seasonal_naive_looks_a_year_back(spark):
    p = ts.periods(_months(spark, {4, 5, 20, 27, 30}), "day", F.col("y"))
    got = {r["step"]: r["forecast"] for r in ts.seasonal_naive(p).collect()}
    assert got == {1: 24.0, 2: 25.0, 3: 26.0}


def test_growth_and_smoothing_with_missing_values(spark):
    p = ts.periods(_months(spark, {1}, n=4), "day", F.col("y"), fill=None)
    assert [r["delta"] for r in ts.growth(p).orderBy("t").collect()] == [None, None, None, 1.0]
    [level] = ts.exponential_smoothing(p, alpha=0.5).collect()
    assert level["forecast"] == 0.5 * 3 + 0.5 * (0.5 * 2 + 0.5 * 0)


@pytest.mark.parametrize("grain, first, second", [("week", "2021-01-04", "2021-01-11"), ("quarter", "2021-01-01", "2021-04-01"), ("year", "2021-01-01", "2022-01-01")])
def test_other_grains(spark, grain, first, second):
    df = spark.createDataFrame([("2021-01-05", 1.0), ("2023-01-05", 2.0), (None, 5.0)], "day string, y double").withColumn("day", F.to_date("day"))
    got = ts.periods(df, "day", F.col("y"), grain).orderBy("t").collect()
    assert [str(r["period"]) for r in got[:2]] == [first, second] and [r["t"] for r in got] == list(range(len(got)))
    assert got[0]["y"] == 1.0 and got[1]["y"] == 0.0 and got[-1]["y"] == 2.0


def test_empty_series(spark):
    assert ts.periods(spark.createDataFrame([], "day date, y double"), "day", F.col("y")).count() == 0


def test_outliers_of_a_group_without_a_name(spark):
    rows = [(g, float(v)) for g in ("a", None) for v in [*range(20), 500]]
    found = anomaly.iqr_rows_by_group(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()
    assert sorted((repr(r["g"]), r["v"]) for r in found) == [("'a'", 500.0), ("None", 500.0)]


def _points(spark, n=300):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2)) * [1.0, 5.0]
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(size=n)
    rows = [(float(a), float(b), float(c), bool(c > 0)) for (a, b), c in zip(x, y)]
    return rows, spark.createDataFrame(rows, "a double, b double, y double, yes boolean")


def test_logistic_scores_are_zero(spark):
    """At the maximum of the likelihood the residuals are orthogonal to every input."""
    rows, df = _points(spark)
    w = {r["term"]: r["coefficient"] for r in regression.logistic(df, F.col("yes"), ["a", "b"]).collect()}
    residual = [yes - 1 / (1 + math.exp(-(w["a"] * a + w["b"] * b + w["(intercept)"]))) for a, b, _, yes in rows]
    for column in ([1.0] * len(rows), [r[0] for r in rows], [r[1] for r in rows]):
        assert abs(np.dot(residual, column)) < 1e-2
    with pytest.raises(ValueError, match="convergence"):
        regression.logistic(df, F.col("yes"), ["a", "b"], max_iter=1)


@pytest.mark.parametrize("rows, digits", [(1500, 9), (7000, 9), (7000, 1)])
def test_area_under_roc_is_that_of_the_summary(spark, rows, digits):
    from pyspark.ml.classification import LogisticRegression

    df = _points(spark, rows)[1].withColumns({c: F.round(c, digits) for c in "ab"}).withColumn("yes", F.col("yes") != (F.col("y") % 1 > 0.7)).coalesce(1)
    want = LogisticRegression(maxIter=200, tol=1e-9).fit(regression._assembled(df, ["a", "b"], F.col("yes").cast("int"))).summary.areaUnderROC
    got = {r["term"]: r["coefficient"] for r in regression.logistic(df, F.col("yes"), ["a", "b"]).collect()}
    assert 0.5 < want < 1 and got["(auc)"] == pytest.approx(want, abs=1e-12)


def test_area_under_roc_is_the_same_in_any_partitions(spark):
    """The points of the curve were cut where a partition of the sorted scores ended."""
    df = _points(spark, 7000)[1].withColumn("yes", F.col("yes") != (F.col("y") % 1 > 0.7))
    areas = [regression.logistic(part, F.col("yes"), ["a", "b"]).where("term = '(auc)'").first()["coefficient"] for part in (df.coalesce(1), df.repartition(7))]
    assert areas[0] == pytest.approx(areas[1], abs=1e-9)


def test_area_under_roc_of_few_scores(spark):
    area = lambda *rows: regression.area_under_roc(spark.createDataFrame(rows, "score double, label double"))
    assert area((0.9, 1.0), (0.5, 1.0), (0.5, 0.0), (0.1, 0.0)) == 0.875
    assert area((0.1, 1.0), (0.9, 0.0)) == 0 and area((0.9, 1.0), (0.1, 1.0)) == 1 and area((0.9, 0.0), (0.1, 0.0)) == 0


def test_scores_are_not_kept(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    files = lambda: sorted(str(p) for p in Path(folder).rglob("*.parquet"))
    kept = files()
    regression.logistic(_points(spark)[1], F.col("yes"), ["a", "b"]).collect()
    assert files() == kept


def test_importance_and_coefficients_use_the_same_rows(spark):
    rows, df = _points(spark)
    gaps = df.unionByName(spark.createDataFrame([(1e6, None, 0.0, True)] * 5, df.schema))
    got = {r["feature"]: r for r in regression.feature_importance(gaps, "y", ["a", "b"], trees=5, depth=3).collect()}
    x, y = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows])
    beta = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0][:2] * x.std(axis=0, ddof=1) / y.std(ddof=1)
    assert [got[c]["std_coefficient"] for c in "ab"] == pytest.approx(beta.tolist())
    assert sum(r["importance"] for r in got.values()) == pytest.approx(1) and got["b"]["importance"] > got["a"]["importance"]


@pytest.mark.parametrize("segments", [customers.kmeans_segments, customers.bisecting_segments])
def test_segments_are_the_nearest_centres(spark, segments):
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (8, 8), (0, 8))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, a double, b double")
    got = {r["id"]: r["segment"] for r in segments(df, ["a", "b"], k=3).collect()}
    label = np.array([got[i] for i in range(len(points))])
    assert sorted(np.bincount(label)) == [40, 40, 40]
    centres = np.array([points[label == s].mean(axis=0) for s in range(3)])
    nearest = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == label).all()


@pytest.mark.parametrize("looked_up", [0, 60, 10_000])
def test_rank_correlations_by_lists_and_by_rows(spark, monkeypatch, looked_up):
    monkeypatch.setattr(desc, "LOOKED_UP", looked_up)
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    frame = pd.DataFrame({"a": x, "b": np.round(x + rng.normal(size=300), 1), "c": rng.integers(0, 4, 300).astype(float), "d": -(x**3), "e": np.repeat([1.0, 2.0], 150)})
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in desc.spearman_matrix(spark.createDataFrame(frame).repartition(4)).collect()}
    want = frame.rank().corr()
    assert len(got) == 10 and all(got[a, b] == pytest.approx(want.loc[a, b], abs=1e-9) for a, b in got)


@pytest.mark.parametrize("rows", [0, 1, 3, 7, 200])
def test_rfm_scores_are_tiles(spark, rows):
    """With ties, missing values and a missing customer."""
    rng = np.random.default_rng(rows)
    made = [(i if i != 2 else None, int(rng.integers(0, 9)), int(rng.integers(1, 5)), None if rng.random() < 0.1 else float(rng.integers(0, 30)) / 4) for i in range(rows)]
    df = spark.createDataFrame(made, "who int, recency int, frequency int, monetary double").repartition(3)
    tiles = {name: F.expr(f"ntile(5) OVER (ORDER BY {order}, who)").cast("long") for name, order in (("r", "recency DESC"), ("f", "frequency"), ("m", "monetary"))}
    assert sorted(map(str, cust.rfm(df, "who").collect())) == sorted(map(str, df.withColumns(tiles).collect()))

"""Exact quantiles against numpy, also when every pass has to narrow further."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeboard.operators import ordered, quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def _values(kind):
    rng = random.Random(7)
    if kind == "hot":
        return [5.0] * 400 + [rng.gauss(5, 3) for _ in range(800)]
    if kind == "few":
        return [float(rng.randrange(6)) for _ in range(900)]
    return [rng.uniform(-1e6, 1e6) for _ in range(1100)]


@pytest.mark.parametrize("kind", ["hot", "few", "spread"])
@pytest.mark.parametrize("read_out", [1, 50, 100_000])
def test_whole_column(spark, monkeypatch, kind, read_out):
    monkeypatch.setattr(quantiles, "READ_OUT", read_out)
    monkeypatch.setattr(quantiles, "SKETCH_SIZE", 64)
    values = _values(kind)
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    got = quantiles.exact_quantiles(df, ["v"], PROBS)["v"]
    assert got == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12)


@pytest.mark.parametrize("large", [50, 10_000])
def test_grouped_with_a_hot_group(spark, monkeypatch, large):
    monkeypatch.setattr(ordered, "LARGE_GROUP", large)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(500)] + [(g, float(i)) for g in "abc" for i in range(11)] + [(None, 1.0), ("z", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["q1"], r["q2"]) for r in quantiles.grouped_quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5}).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert set(got) == {"hot", "a", "b", "c", None}
    for g in got:
        values = [v for k, v in rows if k == g and v is not None]
        assert got[g] == pytest.approx(tuple(np.quantile(values, [0.25, 0.5])))


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles.exact_quantiles(df, ["v"], [0.5]) == {"v": [None]}
    assert quantiles.exact_quantiles(df.limit(0), ["v"], [0.5]) == {"v": [None]}


@pytest.mark.parametrize("n", [2, 3, 10, 501])
def test_middle_value(spark, monkeypatch, n):
    monkeypatch.setattr(quantiles, "READ_OUT", 5)
    df = spark.range(n).select((F.col("id") * 10 + 9007199254740993).alias("k")).repartition(4)
    assert quantiles.middle_value(df, "k") == (True, (n // 2 - 1) * 10 + 9007199254740993)


def test_middle_value_with_missing_keys(spark):
    rows = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k bigint")
    assert quantiles.middle_value(rows(), "k") == (False, None)
    assert quantiles.middle_value(rows(4), "k") == (False, None)
    assert quantiles.middle_value(rows(None, None, 1, 2), "k") == (True, None)
    assert quantiles.middle_value(rows(None, 3, 1, 2), "k") == (True, 1)

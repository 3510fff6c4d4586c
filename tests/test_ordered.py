"""Ordered helpers against pandas, with one group holding much of the rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeboard.operators import ordered


@pytest.fixture(autouse=True, params=[20, 10_000])
def many_ranges(spark, monkeypatch, request):
    """Keep the ranges small, so that groups really cross range borders.

    With a limit of 20 rows some groups are large; with 10,000 none is.
    """
    monkeypatch.setattr(ordered, "LARGE_GROUP", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _skewed(n=600, seed=1):
    rng = random.Random(seed)
    groups = ["hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", "x", "y", "z", None]) for _ in range(n)]
    order = list(range(n))
    rng.shuffle(order)
    return pd.DataFrame({"g": groups, "k": order, "v": [rng.randrange(100) for _ in range(n)]})


@pytest.fixture(scope="module")
def frame(spark):
    pdf = _skewed()
    return pdf, spark.createDataFrame([tuple(r) for r in pdf.itertuples(index=False)], "g string, k bigint, v bigint").repartition(5)


def _pairs(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_position(frame):
    pdf, df = frame
    got = _pairs(ordered.with_position(df, ["k"], "pos", total="n"), "k", "pos", "n")
    assert got == sorted(((k, k + 1, len(pdf)) for k in pdf["k"]), key=repr)


def test_position_descending(frame):
    pdf, df = frame
    got = _pairs(ordered.with_position(df, [F.col("k").desc()], "pos"), "k", "pos")
    assert got == sorted(((k, len(pdf) - k) for k in pdf["k"]), key=repr)


def test_running_totals_without_groups(frame):
    pdf, df = frame
    want = pdf.sort_values("k")
    want = sorted(zip(want["k"], want["v"].cumsum()), key=repr)
    assert _pairs(ordered.running_totals(df, [], ["k"], {"s": "v"}), "k", "s") == want


def test_running_totals_by_group(frame):
    pdf, df = frame
    want = pdf.sort_values("k").copy()
    want["s"] = want.groupby("g", dropna=False)["v"].cumsum()
    want = sorted(zip(want["k"], want["s"]), key=repr)
    assert _pairs(ordered.running_totals(df, ["g"], ["k"], {"s": "v"}), "k", "s") == want


def test_position_in_group(frame):
    pdf, df = frame
    want = pdf.sort_values("k").copy()
    want["p"] = want.groupby("g", dropna=False).cumcount() + 1
    want = sorted(zip(want["k"], want["p"]), key=repr)
    assert _pairs(ordered.position_in_group(df, ["g"], ["k"], "p"), "k", "p") == want


@pytest.mark.parametrize("following", [False, True])
def test_neighbour(frame, following):
    pdf, df = frame
    want = pdf.sort_values("k").copy()
    want["o"] = want.groupby("g", dropna=False)["v"].shift(-1 if following else 1)
    want = sorted(((k, None if pd.isna(o) else int(o)) for k, o in zip(want["k"], want["o"])), key=repr)
    assert _pairs(ordered.with_neighbour(df, ["g"], ["k"], {"o": "v"}, following), "k", "o") == want


@pytest.mark.parametrize("rows", [0, 1, 4, 5, 13])
def test_ntile(spark, rows):
    df = spark.range(rows).withColumn("total", F.lit(rows).cast("bigint"))
    got = df.select("id", ordered.bucket_of(F.col("id") + 1, F.col("total"), 5).alias("b")).collect()
    want = spark.range(rows).selectExpr("id", "cast(ntile(5) over (order by id) as bigint) as b").collect()
    assert sorted(got) == sorted(want)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, k bigint, v bigint")
    assert ordered.with_position(df, ["k"], "p").count() == 0
    assert ordered.running_totals(df, ["g"], ["k"], {"s": "v"}).count() == 0
    assert ordered.with_neighbour(df, ["g"], ["k"], {"o": "v"}).count() == 0


def test_large_inputs_get_more_ranges(spark, sf_dir, monkeypatch):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    monkeypatch.setattr(ordered, "RANGE_BYTES", 2048)
    assert ordered._by_range(orders, [F.col("o_orderkey")]).rdd.getNumPartitions() > 8
    placed = ordered.with_position(orders, ["o_orderkey"], "pos")
    assert placed.where("pos <> o_orderkey + 1").count() == 0 and placed.count() == orders.count()


VALUES = ["none", "gaps", "late"]


def _with_nulls(kind, n=240, seed=4):
    """Values with gaps; "late": NULL over whole ranges before the first value; groups hold NULL."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        g = "hot" if k % 2 else rng.choice(["a", None, None])
        missing = {"none": False, "gaps": rng.random() < 0.5, "late": k < n // 2 or k > n - 20}[kind]
        rows.append((g, k, None if missing else rng.randrange(50), "w" * 200))
    return rows


@pytest.mark.parametrize("kind", VALUES)
@pytest.mark.parametrize("by", [[], ["g"]])
def test_windows_and_ranges_agree_on_nulls(spark, kind, by):
    df = spark.createDataFrame(_with_nulls(kind), "g string, k bigint, v bigint, wide string").repartition(7)
    totals = {}
    for limit in (0, 10**9):
        groups = by or (["one"] if limit else [])
        frame = df.withColumn("one", F.lit(1))
        totals[limit] = _pairs(ordered.running_totals(frame, groups, ["k"], {"t": "v", "d": F.col("v") / 2}, large_group=limit), "g", "k", "v", "t", "d")
    assert totals[0] == totals[10**9]
    if by:
        for following in (False, True):
            found = [
                _pairs(ordered.with_neighbour(df, by, ["k"], {"near": "v", "at": "k"}, following, large_group=limit), "g", "k", "near", "at")
                for limit in (0, 10**9)
            ]
            assert found[0] == found[1]
            places = [_pairs(ordered.position_in_group(df, by, ["k"], large_group=limit), "g", "k", "position") for limit in (0, 10**9)]
            assert places[0] == places[1]

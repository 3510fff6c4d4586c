"""Profiles, charts, insights and dashboards on edge inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeboard.functions.kinds import categorical_cols, default_xy, default_xyz, numeric_cols
from gaugeboard.operators import insights as ins, profile as prof
from gaugeboard.operators.analyses import anomaly, customers as cust, descriptive as desc
from gaugeboard.plans import dashboards as dash


def _doubles(spark, values, name="a"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


def _keyed(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "k bigint, a double").repartition(3)


def _insights(spark, values):
    keyed = _keyed(spark, values).select(F.col("k").cast("string").alias("text_key"), "a", F.col("k").alias("k"))
    return keyed.select(F.format_string("%08d", "k").alias("key"), "a")


def test_which_types_are_numeric(spark):
    df = spark.createDataFrame(
        [], "b byte, s short, i int, l bigint, f float, d double, t boolean, m decimal(10,2), x string, y date"
    )
    assert numeric_cols(df) == ["i", "l", "f", "d"]
    assert numeric_cols(df, decimals=True) == ["i", "l", "f", "d", "m"]
    assert categorical_cols(df) == ["x"]
    assert default_xy(df) == ("x", "i")
    assert default_xyz(df) == ("i", "l", "f")


def test_default_axes_fall_back(spark):
    assert default_xy(spark.createDataFrame([], "a double, b double")) == ("a", "a")
    assert default_xy(spark.createDataFrame([], "s string, t string")) == ("s", "t")
    assert default_xyz(spark.createDataFrame([], "s string, a double")) == ("a", "a", "a")
    assert default_xyz(spark.createDataFrame([], "s string")) is None


def test_null_category_counts_zero(spark):
    df = spark.createDataFrame([("x",), (None,), (None,)], "c string")
    assert [tuple(r) for r in prof.top_categories(df, "c").collect()] == [("x", 1), (None, 0)]


def test_ties_and_limit(spark):
    df = spark.createDataFrame([(c,) for c in "lkjihgfedcba"], "c string")
    assert [r[0] for r in prof.top_categories(df, "c").collect()] == list("abcdefghij")


def test_nan_is_missing(spark):
    row = prof.column_summary(_doubles(spark, [1.0, float("nan"), 3.0, None]), "a").first()
    assert tuple(row) == (4.0, 2.0, 1.0, 3.0, 2)
    assert prof.numeric_moments(_doubles(spark, [1.0, float("nan"), 3.0])).first()["max"] == 3.0


@pytest.mark.parametrize("values", [[], [None, None], [7.0]])
def test_small_inputs_do_not_fail(spark, values):
    df = _doubles(spark, values)
    moments = prof.numeric_moments(df).first()
    assert moments["std"] == 0.0
    assert prof.describe(df).first()["n_values"] == len([v for v in values if v is not None])
    assert prof.histogram(df, "a").count() == (1 if values == [7.0] else 0)
    assert prof.pearson_matrix(df).first()["corr"] is None
    assert [r["type"] for r in ins.insights(_keyed(spark, values).select("a", F.col("k").cast("string").alias("k")), ["k"]).collect()] == ["general"]


def test_histogram_edges(spark):
    rows = prof.histogram(_doubles(spark, [0.0, 1.0, 2.0, 10.0, None, float("nan")]), "a", 5).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 1, 0, 0, 1]
    assert rows[0]["lo"] == 0.0 and rows[-1]["hi"] == 10.0
    flat = prof.histogram(_doubles(spark, [4.0, 4.0]), "a", 5).collect()
    assert [tuple(r) for r in flat] == [(0, 4.0, 4.0, 2)]


def test_correlation_matrix(spark):
    rows = [(float(i), float(2 * i), 5.0, None if i % 3 else float(-i)) for i in range(12)]
    df = spark.createDataFrame(rows, "a double, b double, flat double, gaps double")
    corr = {(r["col_a"], r["col_b"]): r["corr"] for r in prof.pearson_matrix(df).collect()}
    assert len(corr) == 16
    assert all(corr[x, y] == corr[y, x] for x, y in corr)
    assert corr["a", "a"] == pytest.approx(1) and corr["a", "b"] == pytest.approx(1)
    assert corr["a", "gaps"] == pytest.approx(-1)
    assert all(corr["flat", c] is None for c in ("a", "b", "flat", "gaps"))
    nested = prof.corr_map(df).first()["correlations"]
    assert nested["a"]["gaps"] == pytest.approx(-1) and nested["flat"]["a"] is None


def test_correlation_far_from_zero(spark):
    """Large offsets must not drown the signal."""
    df = spark.createDataFrame([(1e9 + i, 1e9 + (i * 7919) % 101) for i in range(200)], "a double, b double")
    xs, ys = zip(*[(float(i), float((i * 7919) % 101)) for i in range(200)])
    mx, my = sum(xs) / 200, sum(ys) / 200
    want = sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / math.sqrt(sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys))
    got = prof.pearson_matrix(df).where("col_a = 'a' AND col_b = 'b'").first()["corr"]
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("seed", range(3))
def test_few_and_many_columns_agree_with_offsets_and_gaps(spark, seed):
    rng = np.random.default_rng(seed)
    base, n = rng.normal(size=200), 200
    columns = []
    for i in range(12):
        x = base * rng.normal() + rng.normal(size=n) * 0.3 + rng.choice([0.0, 1e6, -1e7])
        here = rng.random(n) < rng.choice([1.0, 0.7, 0.3])
        x = np.where(here, x, np.nan)
        if i % 4 == 3:
            x = np.where(np.isnan(columns[-1]), -1e6, x)  # elsewhere far from where the column before is present
        columns.append(x)
    columns[5][:] = 1 / 3
    columns[6][1:] = np.nan
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame(pd.DataFrame(dict(zip(names, columns)))).repartition(3)
    wide = {(r["col_a"], r["col_b"]): r["corr"] for r in prof.pearson_matrix(df).collect()}
    for a, b in [(0, 1), (2, 3), (6, 7), (3, 5), (10, 11), (4, 4)]:
        both = ~np.isnan(columns[a]) & ~np.isnan(columns[b])
        x, y = columns[a][both], columns[b][both]
        want = None if len(x) < 2 or x.min() == x.max() or y.min() == y.max() else np.corrcoef(x, y)[0, 1]
        few = {(r["col_a"], r["col_b"]): r["corr"] for r in prof.pearson_matrix(df, list(dict.fromkeys([names[a], names[b]]))).collect()}
        for got in (few[names[a], names[b]], wide[names[a], names[b]], wide[names[b], names[a]]):
            assert got is None if want is None else got == pytest.approx(want, abs=1e-6)


def test_many_columns_need_several_passes(spark):
    df = spark.range(50).select(*[(F.col("id") * (i % 3 - 1) + F.rand(i)).alias(f"c{i}") for i in range(12)])
    assert prof.pearson_matrix(df).count() == 144


def test_column_names_with_odd_characters(spark):
    df = spark.createDataFrame([(1.0, "x", 2.0), (3.0, "y", 5.0)], "`it's a \"col\"` double, `c.d` string, `back``tick` double")
    assert prof.describe(df).count() == 3
    assert prof.pearson_matrix(df).count() == 4
    assert prof.schema_listing(df).count() == 3
    assert prof.top_categories(df, "c.d").count() == 2


def test_pie_shares(spark):
    df = spark.createDataFrame([(c, float(i + 1)) for i, c in enumerate("abcdefg")] + [(None, 100.0)], "c string, v double")
    rows = prof.pie_share(df, "c", "v").collect()
    assert [r["category"] for r in rows] == [None, "g", "f", "e", "d", "other"]
    assert sum(r["share"] for r in rows) == pytest.approx(1)
    assert rows[-1]["total"] == pytest.approx(1 + 2 + 3)


def test_outlier_needs_eleven_rows(spark):
    assert ins.outlier_insights(_doubles(spark, [0.0] * 9 + [1e9])).count() == 0
    assert ins.outlier_insights(_doubles(spark, [0.0] * 10 + [1e9])).count() == 1
    assert ins.outlier_insights(_doubles(spark, [0.0] * 10 + [-1e9])).count() == 0
    assert ins.outlier_insights(_doubles(spark, [3.0] * 20)).count() == 0


@pytest.mark.parametrize("as_text", [False, True])
def test_trend_rules(spark, as_text):
    def trend(values):
        df = _keyed(spark, values)
        if as_text:
            df = df.select(F.format_string("%05d", "k").alias("k"), "a")
        found = ins.trend_insights(df, ["k"]).where("`column` = 'a'").collect()
        return (found[0]["direction"], round(found[0]["pct_change"], 6)) if found else None

    assert trend([1.0] * 5 + [9.0] * 5) is None  # ten rows are too few
    assert trend([1.0] * 5 + [9.0] * 6) == ("Upward", 800.0)  # the first half is floor(n / 2)
    assert trend([10.0] * 6 + [12.0] * 6) is None  # exactly 20 percent
    assert trend([10.0] * 6 + [7.9] * 6) == ("Downward", -21.0)
    assert trend([-10.0] * 6 + [-5.0] * 6) == ("Downward", -50.0)  # relative to the signed mean
    assert trend([0.0] * 6 + [5.0] * 6) is None  # no change relative to zero
    assert trend([None] * 6 + [5.0] * 6) is None


def test_insights_keep_five_outliers_first(spark):
    cols = [f"c{i}" for i in range(6)]
    rows = [tuple([f"{i:03d}"] + [1.0 if i < 20 else (1e6 if i == 39 else 2.0)] * 6) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, " + ", ".join(f"{c} double" for c in cols))
    found = ins.insights(df, ["k"]).orderBy("ordinal").collect()
    assert [r["title"] for r in found] == [f"Extreme Value in c{i}" for i in range(5)]
    more = ins.insights(df.select("k", "c0", "c1"), ["k"]).orderBy("ordinal").collect()
    assert [r["type"] for r in more] == ["outlier", "outlier", "trend", "trend"]
    assert more[2]["severity"] == "positive"


def test_insights_do_not_depend_on_partitions(spark):
    df = _keyed(spark, [float(i % 17) * (1 + i // 40) for i in range(80)])
    a = ins.insights(df.repartition(1), ["k"]).collect()
    assert a == ins.insights(df.repartition(7), ["k"]).collect()


@pytest.mark.parametrize("style", ["simple", "ml", "powerbi", "unknown"])
def test_dashboard_without_numbers_or_text(spark, style):
    text = spark.createDataFrame([("a", "x"), ("b", "y")], "s string, t string")
    rows = dash.dashboard(text, style, ["s"]).collect()
    kinds = {r["chart_type"] for r in rows if r["section"] == "chart"}
    assert kinds == (set() if style == "ml" else {"bar"})
    assert [r["series"] for r in rows if r["section"] == "insight"] == ["general"]
    numbers = spark.createDataFrame([(1.0, 2.0), (3.0, 1.0)], "a double, b double")
    kinds = {r["chart_type"] for r in dash.dashboard(numbers, style, ["a"]).collect() if r["section"] == "chart"}
    assert kinds == ({"scatter", "heatmap"} if style == "ml" else {"histogram"})


def test_single_chart_takes_the_first_place(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "a double")
    rows = dash.powerbi_dashboard(df, ["a"]).where("section = 'chart'").collect()
    assert {(r["grid_x"], r["grid_y"], r["grid_w"], r["grid_h"]) for r in rows} == {(0, 0, 6, 4)}


def test_scatter_colour(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    assert tuple(prof.scatter_points(df).first()) == (1.0, 2.0, 3.0, 3.0)
    assert tuple(prof.scatter_points(df, z="none").first()) == (1.0, 2.0, None, 2.0)


def test_manifest(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "a double, b double")
    row = dash.manifest(df).first()
    assert row["row_count"] == 2 and row["correlations"]["a"]["b"] == pytest.approx(1)
    assert dash.manifest(df.select("a")).first()["correlations"] is None


def test_spearman_with_gaps_and_ties(spark):
    rows = [(1.0, 1.0, None), (2.0, 4.0, 1.0), (2.0, 9.0, 3.0), (4.0, 16.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in desc.spearman_matrix(df).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert got["a", "b"] == pytest.approx(0.948683, abs=1e-6)
    assert got["b", "c"] == pytest.approx(0.5)
    assert got["a", "c"] == pytest.approx(0.0)


def test_mode_prefers_the_smaller_value(spark):
    assert tuple(desc.modes(_doubles(spark, [3.0, 3.0, 1.0, 1.0, 2.0])).first()) == ("a", 1.0, 2)


def test_anomalies(spark):
    values = [float(i % 5) for i in range(40)] + [100.0]
    assert [r["a"] for r in anomaly.zscore_rows(_doubles(spark, values), "a").collect()] == [100.0]
    assert [r["a"] for r in anomaly.iqr_rows(_doubles(spark, values), "a").collect()] == [100.0]
    assert anomaly.zscore_rows(_doubles(spark, [1.0, 1.0]), "a").count() == 0
    assert anomaly.iqr_rows(_doubles(spark, [None]), "a").count() == 0


def test_funnel_steps_are_strictly_later(spark):
    rows = [(1, "view", 1), (1, "click", 1), (2, "view", 1), (2, "click", 2), (2, "buy", 3), (3, "click", 1), (3, "view", 2)]
    df = spark.createDataFrame(rows, "u bigint, e string, t bigint")
    got = cust.funnel(df, ["u"], "e", ["view", "click", "buy"], "t").orderBy("step_no").collect()
    assert [r["entities"] for r in got] == [3, 1, 1]
    assert got[1]["step_rate"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("n", [1, 3, 5, 50])
@pytest.mark.parametrize("descending", [False, True])
def test_first_rows_of_a_wide_table(spark, n, descending):
    rows = [(k, i, "a", "b", "c") for i, k in enumerate([5, None, 3, 3, 9, None, 1])]
    df = spark.createDataFrame(rows, "k int, tie int, a string, b string, c string").repartition(3)
    got = [(r["k"], r["tie"]) for r in prof.first_rows(df, ["k", "tie"], n, descending).collect()]
    want = sorted(((k, t) for k, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=descending)
    assert got == want[:n]


@pytest.mark.parametrize("kind", ["bigint", "double", "string"])
def test_halves_do_not_depend_on_the_type_of_the_key(spark, kind):
    """Twenty rows without a key come first; the tied key in the middle belongs to the first half."""
    rows = [(None, 1.0)] * 20 + [(100 + k // 4, 5.0 + k) for k in range(24)]
    df = spark.createDataFrame(rows, "k bigint, v double").select(F.col("k").cast(kind).alias("k"), "v").repartition(3)
    [found] = ins.trend_insights(df, ["k"]).where("`column` = 'v'").collect()
    first = [1.0] * 20 + [5.0, 6.0, 7.0, 8.0]
    second = [5.0 + k for k in range(4, 24)]
    assert (found["first_mean"], found["second_mean"]) == (sum(first) / 24, sum(second) / 20)


def test_halves_of_mostly_missing_keys(spark):
    df = spark.createDataFrame([(None, 1.0)] * 20 + [(k, 9.0) for k in range(10)], "k bigint, v double")
    for kind in ("bigint", "double"):
        [found] = ins.trend_insights(df.select(F.col("k").cast(kind).alias("k"), "v"), ["k"]).where("`column` = 'v'").collect()
        assert (found["first_mean"], found["second_mean"]) == (1.0, 9.0)


def test_spearman_ranks_classes_of_columns_together(spark):
    """Columns with the same gaps share a pass; every pair agrees with pandas."""
    rows = [(i, (i * 7) % 11 + 0.5, (i * 5) % 13 if i % 3 else None, (i * 3) % 7 if i % 3 else None, float(i % 5) if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "a bigint, b double, `c.d` bigint, e bigint, f double")
    frame = df.toPandas().astype(float)
    want = frame.corr("spearman")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in desc.spearman_matrix(df).collect()}
    assert len(got) == 10
    for (a, b), corr in got.items():
        assert abs(corr - want.loc[a, b]) < 1e-9, (a, b)


@pytest.mark.parametrize("bins", [1, 7, 500])
def test_line_points_keep_what_a_pixel_shows(spark, bins):
    rng = np.random.default_rng(bins)
    xs, ys = np.sort(rng.integers(0, 300, 400)).astype(float), np.round(rng.normal(size=400), 1)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(xs, ys)] + [(None, 1.0), (2.0, None), (float("nan"), 0.0)], "x double, y double").repartition(5)
    got = [tuple(r) for r in prof.line_points(df, "x", "y", bins).collect()]
    assert len(got) == len(set(got)) <= 4 * bins
    at = np.minimum((xs - xs.min()) / (xs.max() - xs.min()) * bins, bins - 1).astype(int)
    for b in np.unique(at):
        inside = sorted(zip(xs[at == b].tolist(), ys[at == b].tolist()))
        by_y = sorted((y, x) for x, y in inside)
        want = {inside[0], inside[-1], by_y[0][::-1], by_y[-1][::-1]}
        assert {(x, y) for bin_, x, y in got if bin_ == b} == want


def test_lines_of_few_points(spark):
    assert prof.line_points(_doubles(spark, []).selectExpr("a AS x", "a AS y"), "x", "y").collect() == []
    assert [tuple(r) for r in prof.line_points(spark.createDataFrame([(3.0, 1.0)], "x double, y double"), "x", "y").collect()] == [(0, 3.0, 1.0)]
    times = spark.sql("SELECT explode(sequence(timestamp'2024-01-01', timestamp'2024-01-02', interval 6 hours)) AS x, 1 AS y")
    assert len(prof.line_points(times, "x", "y", 2).collect()) == 4

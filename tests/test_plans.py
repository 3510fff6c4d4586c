"""What the physical plans must and must not contain."""

import contextlib
import io

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def shown(spark, sf_dir):
    return lambda name: plan(QUERIES[name](spark, sf_dir))


def test_filters_reach_the_scan(shown):
    assert "EqualTo(o_orderkey,42)" in shown("point_lookup")
    assert "EqualTo(c_nationkey,7)" in shown("tenant_filter")
    composite = shown("composite_lookup")
    assert "EqualTo(l_orderkey,42)" in composite and "EqualTo(l_linenumber,3)" in composite


def test_only_named_columns_are_read(shown):
    assert "ReadSchema: struct<event_type:string>" in shown("top_categories")
    assert "ReadSchema: struct<l_extendedprice:double>" in shown("column_summary")


def test_top_n_is_not_a_full_sort(shown):
    for name in ("top_categories", "feed_top50", "preview_rows", "chart_line_points"):
        text = shown(name)
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text, name


def test_summaries_shuffle_one_row_per_task(shown):
    for name in ("numeric_moments", "pearson_matrix", "rule_violation_counts", "audit_nulls"):
        text = shown(name)
        assert text.count("Scan parquet") <= 2 and "CartesianProduct" not in text, name
        assert "SortMergeJoin" not in text, name


@pytest.mark.parametrize("name", ["latest_child", "first_child", "lifecycle_latest", "upsert_latest"])
def test_latest_rows_aggregate_before_the_shuffle(shown, name):
    text = shown(name)
    assert "Window" not in text and "partial_" in text


def test_no_pair_joins_or_python(shown):
    for name in sorted(QUERIES):
        if name.startswith(("stream_", "an_", "csv_", "profile_", "parquet_", "row_callback", "op", "pipeline")):
            continue
        text = shown(name)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "Python" not in text and "ArrowEval" not in text, name


def scans(text: str) -> int:
    return sum(line.strip().startswith("(") and "Scan" in line for line in text.splitlines())


def test_wide_correlations_read_the_table_once(spark, tmp_path):
    from gaugeboard.operators.profile import pearson_matrix

    spark.range(50).selectExpr(*[f"id * {i} % 7 + id AS c{i}" for i in range(60)]).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    assert scans(plan(pearson_matrix(df))) == 1


def test_the_feed_cuts_its_page_once(shown):
    assert "TakeOrderedAndProject" not in shown("feed_enriched")


def test_a_cascade_does_not_repeat_the_levels_above(shown):
    assert scans(shown("cascade_survivors")) <= 7


@pytest.mark.parametrize("style", ["simple", "ml", "powerbi"])
def test_a_document_holds_every_row_of_its_dashboard(spark, sf_dir, style):
    from gaugeboard.plans.dashboards import dashboard, document
    from gaugeboard.session import materialize

    rows = materialize(dashboard(spark.read.parquet(f"{sf_dir}/events.parquet"), style, ["event_id"]), "rows")
    by_section = {s: [r for r in rows.collect() if r["section"] == s] for s in ("kpi", "chart", "insight")}
    found = document(rows, style).first()
    assert found["layout"] == style
    assert [(k["label"], k["value"]) for k in found["kpis"]] == [(r["title"], r["text"]) for r in sorted(by_section["kpi"], key=lambda r: r["ordinal"])]
    assert [tuple(i) for i in found["insights"]] == [
        (r["series"], r["title"], r["text"], r["x_label"]) for r in sorted(by_section["insight"], key=lambda r: r["ordinal"])
    ]
    assert [c["id"] for c in found["charts"]] == sorted({r["chart_id"] for r in by_section["chart"]})
    for chart in found["charts"]:
        own = [r for r in by_section["chart"] if r["chart_id"] == chart["id"]]
        point = lambda r: (r["series"], r["ordinal"], r["x_label"], r["x_num"], r["y"])
        assert sorted(map(repr, map(tuple, chart["data"]))) == sorted(map(repr, map(point, own)))
        assert chart["grid_pos"] is None or tuple(chart["grid_pos"]) == tuple(own[0][f"grid_{c}"] for c in "xywh")


def test_a_document_of_no_rows(spark):
    from gaugeboard.plans.dashboards import SCHEMA, document

    assert tuple(document(spark.createDataFrame([], SCHEMA), "simple").first()) == ("simple", [], [], [])


def test_quantiles_of_a_joined_input_read_it_as_often_for_one_column_as_for_eight(spark, monkeypatch):
    """The number of shuffles tells, as the joined input brings one with it each time it is read."""
    from gaugeboard.operators import quantiles

    monkeypatch.setattr(quantiles, "READ_OUT", 2_000)
    left = spark.range(20_000).selectExpr("id AS k", *[f"pow(id * {2 * i + 3} % 9973, 2) AS c{i}" for i in range(8)])
    joined = left.join(spark.range(20_000).selectExpr("id AS k").repartition(3, "k"), "k")
    plans = []
    frame = type(joined)
    real = frame.collect

    def collected(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    def joins(cols):
        plans.clear()
        with monkeypatch.context() as patched:
            patched.setattr(frame, "collect", collected)
            found = quantiles.exact_quantiles(joined, cols, [0.25, 0.5, 0.75])
        return found, sum(text.count("Join Inner") for text in plans)

    one, first = joins(["c0"])
    eight, all_of_them = joins([f"c{i}" for i in range(8)])
    assert one["c0"] == eight["c0"] and 0 < all_of_them <= first + 2
    assert max(text.count("Join Inner") for text in plans) == 1


def test_ranks_of_many_columns_take_two_shuffles(spark, monkeypatch, tmp_path):
    from gaugeboard.operators.analyses import descriptive

    monkeypatch.setattr(descriptive, "LOOKED_UP", 50)
    spark.range(400).selectExpr(*[f"id * {2 * i + 3} % 397 AS c{i}" for i in range(6)], "id % 7 AS few").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))

    def shuffles(cols):
        text = plan(descriptive._ranked(df, cols))
        return sum(line.strip().startswith("(") and ") Exchange" in line for line in text.splitlines())

    assert shuffles(["c0", "c1", "few"]) == shuffles(["c0", "c1", "c2", "c3", "c4", "c5", "few"]) <= 3


@pytest.mark.parametrize("read_out", [100_000, 50])
@pytest.mark.parametrize("style", ["simple", "ml", "powerbi"])
def test_dashboards_read_the_table_five_times_at_most(spark, monkeypatch, style, read_out):
    from gaugeboard.operators import quantiles
    from gaugeboard.plans.dashboards import dashboard

    monkeypatch.setattr(quantiles, "READ_OUT", read_out)
    rows = 2_000
    passed = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    plain = spark.range(rows).selectExpr("id AS k", "CAST(id % 7 AS STRING) AS c", "id * 37 % 101 AS a", "IF(id % 3 = 0, NULL, id * 1.5D) AS b")
    table = plain.mapInArrow(counting, plain.schema)
    got = dashboard(table, style, ["k"])
    found = sorted(map(str, got.collect()))
    # Without reuse of shuffles, every section reads the table on its own.
    assert passed.value <= 5 * rows
    assert found == sorted(map(str, dashboard(plain, style, ["k"]).collect()))


def test_dashboards_of_odd_tables(spark):
    from gaugeboard.plans.dashboards import dashboard

    for sql in (
        "SELECT id AS k FROM range(0)",
        "SELECT CAST(id AS STRING) AS k FROM range(5)",
        "SELECT CAST(NULL AS LONG) AS k, CAST(NULL AS STRING) AS c, CAST('NaN' AS DOUBLE) AS v",
        "SELECT id AS k, 4.0D AS flat, 'x' AS c FROM range(30)",
        "SELECT timestamp'2024-01-01' AS t, id AS v FROM range(3)",
    ):
        df = spark.sql(sql)
        for style in ("simple", "ml", "powerbi", "unknown"):
            assert dashboard(df, style, df.columns[:1]).where("section = 'kpi'").count() == 2

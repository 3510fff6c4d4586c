"""CSV scans, audits, the result cache and the row callback."""

import pytest
from pyspark.sql import types as T

from gaugeboard import session
from gaugeboard.sources import cache, csv_errors as ce, files


@pytest.fixture
def write(tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    return put


def test_inference(spark, write):
    path = write("basic.csv", "d,b,i,f,s\n2024-01-01,true,1,1.5,x\n2024-01-02,false,2,2.5,y\n")
    types = dict(files.read_csv(spark, path).dtypes)
    assert types == {"d": "date", "b": "boolean", "i": "int", "f": "double", "s": "string"}
    assert dict(files.read_csv(spark, path, dates_as_strings=True).dtypes)["d"] == "string"


def test_bad_cells(spark, write):
    path = write("bad.csv", "i,f,s\n1,1.5,x\nzz,2.5,y\n3,,z\n")
    schema = T._parse_datatype_string("i bigint, f double, s string")
    assert [tuple(r) for r in files.read_csv(spark, path, schema).collect()] == [(1, 1.5, "x"), (None, 2.5, "y"), (3, None, "z")]
    with pytest.raises(Exception, match="(?i)malformed|bad record|failfast"):
        files.read_csv(spark, path, schema, on_error="fail").collect()


def test_preview_skips_blank_lines(spark, write):
    body = "".join(f"{i},x\n" + ("\n" if i % 10 == 0 else "") for i in range(120))
    rows = files.csv_preview(spark, write("blank.csv", "a,b\n" + body)).collect()
    assert len(rows) == 100 and rows[0]["a"] == "0" and rows[-1]["a"] == "99"


def test_audit_by_file(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\n1,2\n3\n4,5,6\nx,1\n\n")
    (tmp_path / "two.csv").write_text("a,b\n1,2\n")
    schema = T._parse_datatype_string("a int, b int")
    got = {r["file"].rsplit("/", 1)[1]: (r["rows"], r["good_rows"], r["bad_rows"]) for r in files.csv_audit(spark, str(tmp_path), schema).collect()}
    assert got == {"one.csv": (4, 1, 3), "two.csv": (1, 1, 0)}


def test_cache_computes_once_per_key(spark, tmp_path):
    calls = []

    def compute(v):
        calls.append(v)
        return spark.createDataFrame([(v,)], "v int")

    path = str(tmp_path / "cache")
    get = lambda d, s, v: cache.cached_result(spark, path, d, s, "v int", lambda: compute(v)).collect()[0]["v"]
    assert get("d", "simple", 1) == 1 and get("d", "ml", 2) == 2 and get("d", "simple", 3) == 1
    assert calls == [1, 2]


def test_json_records_keep_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert files.records_json(df).first()[0] == '{"a":1,"b":null}'


def test_row_callback(spark):
    df = spark.range(10).repartition(3)
    got = files.map_rows(df, lambda rows: rows.assign(id=rows["id"] * 2), "id bigint")
    assert sorted(r["id"] for r in got.collect()) == list(range(0, 20, 2))


def test_bucketed_tables_join_without_a_shuffle(spark):
    left = spark.range(50).withColumnRenamed("id", "k")
    files.write_bucketed(left, "bucket_left", ["k"], 4, mode="overwrite")
    files.write_bucketed(left, "bucket_right", ["k"], 4, mode="overwrite")
    joined = spark.table("bucket_left").hint("merge").join(spark.table("bucket_right"), "k")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 50


def test_scratch_is_shared_and_can_be_cleared(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    copy = session.materialize(spark.range(5), "t")
    assert copy.inputFiles()[0].removeprefix("file://").startswith(root)
    session.clear_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(copy.inputFiles()[0])


def test_the_end_of_a_row_callback_gets_all_results(spark):
    seen = []
    got = files.map_rows(spark.range(10), lambda rows: rows + 1, "id bigint", complete=lambda results: seen.append(results.count()))
    assert seen == [10] and sorted(r["id"] for r in got.collect()) == list(range(1, 11))


FAULTY = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.StringType()), T.StructField("v", T.DoubleType())])


@pytest.mark.parametrize("split", [40, 1 << 20])
def test_faults_by_record_across_splits(spark, tmp_path, split):
    faults = {3: ("1,a", ce.TOO_FEW), 7: ("1,a,2,3", ce.TOO_MANY), 20: ("x,a,2", ce.BAD_CELL), 21: ('1,"a,2', ce.OPEN_QUOTE), 40: ('1,"a"b,2', ce.TEXT_AFTER_QUOTE), 60: ("1,a,z", ce.BAD_CELL)}
    good = ['1,"a, b",2', "5,,", '6,"say ""hi""",1e3', '7,a"b,2', ",,"]
    for f in range(2):
        lines = ["k,t,v"]
        for i in range(1, 61):
            lines.append(faults[i + f][0] if i + f in faults else good[i % len(good)])
            lines += ["", "   "] if i % 9 == 0 else []
        (tmp_path / f"file{f}.csv").write_text("\n".join(lines) + "\n")
    settings = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = ce.csv_errors(spark, str(tmp_path), FAULTY).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = sorted((r["file"][-5], r["record"], r["kind"], r["text"]) for r in found)
    assert got == sorted((str(f), i - f, kind, text) for f in range(2) for i, (text, kind) in faults.items() if 1 <= i - f <= 60)


def test_faults_of_files_without_header_or_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,a,2\n2,b\n")
    assert [tuple(r)[1:] for r in ce.csv_errors(spark, str(tmp_path / "a.csv"), FAULTY, header=False).collect()] == [(2, ce.TOO_FEW, "2,b")]
    (tmp_path / "b.csv").write_text("")
    assert ce.csv_errors(spark, str(tmp_path / "b.csv"), FAULTY).collect() == []


def test_a_changed_input_has_a_new_result(spark, tmp_path):
    table, store, calls = str(tmp_path / "in"), str(tmp_path / "store"), []

    def result():
        def compute():
            calls.append(1)
            return spark.read.parquet(table).selectExpr("sum(id) AS total")

        return cache.cached_result(spark, store, "a/b = c", "s", "total long", compute, cache.input_version(spark, table)).first()["total"]

    spark.range(5).write.parquet(table)
    assert (result(), result(), len(calls)) == (10, 10, 1)
    spark.range(7).write.mode("overwrite").parquet(table)
    assert (result(), result(), len(calls)) == (21, 21, 2)
    spark.range(3).write.mode("append").parquet(table)
    assert (result(), len(calls)) == (24, 3)


def test_an_empty_result_is_not_computed_again(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(0).selectExpr("id AS total")

    for _ in range(3):
        assert cache.cached_result(spark, str(tmp_path), "d", "s", "total long", compute).count() == 0
    assert len(calls) == 1


def test_scopes_delete_their_intermediate_tables(spark):
    from gaugeboard.sources.folders import Folder

    def there(df):
        return all(Folder(spark, str(f).rsplit("/", 1)[0]).names() for f in df.inputFiles())

    before = session.materialize(spark.range(3), "kept")
    with session.scratch_scope(spark):
        outer = session.materialize(spark.range(4), "outer")
        with pytest.raises(RuntimeError), session.scratch_scope(spark):
            inner = session.materialize(spark.range(5), "inner")
            assert there(inner)
            raise RuntimeError
        assert not there(inner) and outer.count() == 4
        assert session.scratch_path(spark, "x").count("scope-") == 1
    assert not there(outer) and before.count() == 3
    assert "scope-" not in session.scratch_path(spark, "x")

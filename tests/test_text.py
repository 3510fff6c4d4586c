"""Scalar functions against the values JavaScript gives."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from gaugeboard.functions import text as txt
from gaugeboard.plans import all_queries


def _one(spark, column, **values):
    types = {str: "string", int: "bigint", float: "double", bool: "boolean", dt.datetime: "timestamp_ntz"}
    schema = ", ".join(f"{n} {types.get(type(v), 'string')}" for n, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("value", [1.005, 2.5, 0.125, -1.005, 8.345, 0.0, 999.995, 123456789.125, 1e-9, 0.999, 10.235])
@pytest.mark.parametrize("digits", [0, 1, 2])
def test_fixed_rounds_the_exact_value(spark, value, digits):
    want = str(Decimal(value).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))
    want = want if value >= 0 else "-" + want.lstrip("-")
    assert _one(spark, txt.fmt_fixed(F.col("x"), digits), x=value) == want


def test_fixed_missing(spark):
    assert spark.createDataFrame([(None,)], "x double").select(txt.fmt_fixed(F.col("x"), 2)).first()[0] is None


def test_grouped_numbers(spark):
    assert _one(spark, txt.fmt_integer(F.col("x")), x=60000) == "60,000"
    assert _one(spark, txt.fmt_locale(F.col("x")), x=1234.5) == "1,234.5"
    assert _one(spark, txt.fmt_locale(F.col("x")), x=100.0) == "100"
    assert _one(spark, txt.fmt_locale(F.col("x")), x=1200.0005) in ("1,200.001", "1,200")


@pytest.mark.parametrize(
    "name, stripped, clean, parquet",
    [
        ("a.csv.csv", "a.csv", "a.csv.csv", "a.parquet.csv"),
        (".csv", "", ".csv", ".parquet"),
        ("noext", "noext", "noext", "noext"),
        ("ü x.CSV", "ü x", "__x.CSV", "ü x.CSV"),
        ("a/b.csv", "a/b", "a_b.csv", "a/b.parquet"),
    ],
)
def test_file_names(spark, name, stripped, clean, parquet):
    assert _one(spark, txt.strip_extension(F.col("x")), x=name) == stripped
    assert _one(spark, txt.sanitize_name(F.col("x")), x=name) == clean
    assert _one(spark, txt.swap_first(F.col("x"), ".csv", ".parquet"), x=name) == parquet


def test_object_key(spark):
    key = txt.object_key(F.lit("o"), F.lit("p"), F.col("t"), F.lit("my file.csv"))
    assert _one(spark, key, t=dt.datetime(1970, 1, 1, 0, 0, 1)) == "o/p/1000-my_file.csv"


def test_names(spark):
    df = spark.createDataFrame([("Ann", "Lee"), ("Ann", None), (None, "Lee"), (None, None), ("", "Lee")], "a string, b string")
    got = [r[0] for r in df.select(txt.full_name(F.col("a"), F.col("b"))).collect()]
    assert got == ["Ann Lee", "Ann", "Lee", "", "Lee"]
    got = [r[0] for r in df.select(txt.initial(F.col("a"))).collect()]
    assert got == ["A", "A", "U", "U", "U"]
    got = [r[0] for r in df.select(txt.text_or(F.col("a"), "none")).collect()]
    assert got == ["Ann", "Ann", "none", "none", "none"]
    got = [r[0] for r in spark.createDataFrame([(" ",), ("x ",), (None,)], "a string").select(txt.has_text(F.col("a"))).collect()]
    assert got == [False, True, False]


def test_safe_integers(spark):
    edge = 2**53 - 1
    df = spark.createDataFrame([(edge,), (edge + 1,), (-edge,), (-edge - 1,), (-(2**63),), (None,)], "x bigint")
    got = [tuple(r[0]) for r in df.select(txt.safe_integer(F.col("x"))).collect()]
    assert got == [(edge, None), (None, str(edge + 1)), (-edge, None), (None, str(-edge - 1)), (None, str(-(2**63))), (None, None)]


_KEYS = [(5, 3), (3_149_999, 119_999), (36_000_000, 1_200_000), (-36_000_000, 1_200_000), (10**14, 10**14), (None, 3), (3, None), (0, 2**63 - 1)]


def _safe(n):
    return (None, None) if n is None else (n, None) if abs(n) < 2**53 else (None, str(n))


@pytest.mark.parametrize("key, part", _KEYS)
def test_products_past_64_bits(spark, tmp_path, key, part):
    """Keys of larger tables: the product is text, as it is for any number a double cannot hold."""
    rows = spark.createDataFrame([(key, part, 1, 1)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    [line] = all_queries().QUERIES["safe_integer"](spark, str(tmp_path)).collect()
    assert tuple(line) == (key, part, 1, 1, *_safe(None if key is None or part is None else key * 100000007 * (part + 1)))


@pytest.mark.parametrize("key, customer", _KEYS)
def test_products_past_64_bits_inside_documents(spark, tmp_path, key, customer):
    spark.createDataFrame([(key, customer, "F")], "o_orderkey bigint, o_custkey bigint, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    [order] = all_queries().QUERIES["safe_integer_nested"](spark, str(tmp_path)).collect()
    assert tuple(order) == (key, _safe(customer)[0], *_safe(None if key is None or customer is None else key * 1000003 * (customer + 1) * 1009), "F")


def test_safe_integers_inside_documents(spark):
    big = 2**60
    schema = "d struct<a:array<bigint>, m:map<string,bigint>, s:struct<n:bigint,t:string>, i:int>"
    df = spark.createDataFrame([(([1, big, None], {"k": big}, (2, "x"), 7),), (None,)], schema)
    rows = [r[0] for r in df.select(txt.safe_integers(F.col("d"), df.schema["d"].dataType)).collect()]
    assert rows[1] is None
    got = rows[0]
    assert [tuple(v) for v in got["a"]] == [(1, None), (None, str(big)), (None, None)]
    assert tuple(got["m"]["k"]) == (None, str(big)) and tuple(got["s"]["n"]) == (2, None)
    assert got["s"]["t"] == "x" and got["i"] == 7


@pytest.mark.parametrize(
    "seconds, age",
    [(5, "less than a minute ago"), (60, "1 minute ago"), (7200, "2 hours ago"), (3 * 86400, "3 days ago"), (400 * 86400, "1 year ago")],
)
def test_age(spark, seconds, age):
    now = dt.datetime(2024, 6, 1)
    column = txt.age_bucket(F.col("t"), F.lit(now).cast("timestamp_ntz"))
    assert _one(spark, column, t=now - dt.timedelta(seconds=seconds)) == age


def test_percent_change(spark):
    df = spark.createDataFrame([(10.0, 12.0), (0.0, 5.0), (-10.0, -5.0)], "a double, b double")
    got = [r[0] for r in df.select(txt.percent_change(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(20), None, pytest.approx(-50)]

"""Sources and sinks, on files that Spark writes from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from gaugeboard.plans import dashboards as dash
from gaugeboard.plans.profile_queries import _EVENT_NUMBERS, _PART_NUMBERS, _corr_sql, _head_sql, _bar_sql, _histogram_rows_sql, rounded
from gaugeboard.plans.registry import Tables, query
from gaugeboard.session import scratch_path
from gaugeboard.sources import cache, csv_errors, files


def _csv_of(t: Tables, df, label: str) -> str:
    path = scratch_path(t.spark, label)
    df.write.option("header", True).csv(path)
    return path


_ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


@query(
    "csv_lenient_scan",
    """SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders""",
)
def csv_lenient_scan(t: Tables):
    """The price of some rows is not a number: a bad cell is read as NULL."""
    price = F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", price.alias("o_totalprice"))
    path = _csv_of(t, rows, "lenient")
    schema = T.StructType([t.orders.schema[c] for c in rows.columns])
    return files.read_csv(t.spark, path, schema)


@query("csv_strict_scan", f"SELECT {_ORDER_COLUMNS} FROM orders")
def csv_strict_scan(t: Tables):
    rows = t.orders.select(*_ORDER_COLUMNS.split(", "))
    return files.read_csv(t.spark, _csv_of(t, rows, "strict"), rows.schema, on_error="fail")


@query("csv_inferred_scan", "SELECT event_id, user_id, event_type, value FROM events")
def csv_inferred_scan(t: Tables):
    rows = t.events.select("event_id", "user_id", "event_type", "value")
    scanned = files.read_csv(t.spark, _csv_of(t, rows, "inferred"))
    return scanned.select(F.col("event_id").cast("bigint"), F.col("user_id").cast("bigint"), "event_type", "value")


@query(
    "csv_preview",
    "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events ORDER BY events.event_id LIMIT 100",
)
def csv_preview(t: Tables):
    """The first 100 rows of files written in the order of the key."""
    rows = t.events.select("event_id", "event_type", "user_id").repartitionByRange(3, "event_id").sortWithinPartitions("event_id")
    return files.csv_preview(t.spark, _csv_of(t, rows, "preview"), 100)


@query(
    "csv_audit",
    """SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderstatus = 'F') AS good_rows,
              count(*) FILTER (WHERE o_orderstatus <> 'F') AS bad_rows,
              count(*) + count(*) FILTER (WHERE o_orderstatus = 'F') AS filled_cells FROM orders""",
)
def csv_audit(t: Tables):
    """Rows of status P lack a field and rows of status O have a bad cell."""
    line = (
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey").cast("string"))
        .when(F.col("o_orderstatus") == "O", F.concat_ws(",", "o_orderkey", F.lit("zz")))
        .otherwise(F.concat_ws(",", "o_orderkey", "o_custkey"))
    )
    path = scratch_path(t.spark, "audit")
    t.orders.select(line.alias("value")).write.text(path)
    schema = T.StructType([t.orders.schema["o_orderkey"], t.orders.schema["o_custkey"]])
    audited = files.csv_audit(t.spark, path, schema, header=False)
    return audited.agg(*[F.sum(c).alias(c) for c in ("rows", "good_rows", "bad_rows", "filled_cells")])


_FAULTS = [
    ("too few fields", "o_orderkey", "o_orderkey || ',' || o_orderstatus"),
    ("too many fields", "o_orderkey + 1", "o_orderkey || ',' || o_orderstatus || ',1,2'"),
    ("bad cell", "o_orderkey + 2", "o_orderkey || ',' || o_orderstatus || ',12x'"),
    ("quote not closed", "o_orderkey + 3", "o_orderkey || ',\"' || o_orderstatus || ',7'"),
    ("text after a quoted field", "o_orderkey + 4", "o_orderkey || ',\"' || o_orderstatus || '\"z,7'"),
]
_LINE = "CASE " + " ".join(f"WHEN ({k}) % 11 = 0 THEN {text}" for _, k, text in _FAULTS) + " ELSE o_orderkey || ',\"' || o_orderpriority || ', \"\"x\"\"\",' || o_custkey END"


@query(
    "csv_errors",
    f"""SELECT o_orderkey % 3 AS file, row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) AS record,
               CASE {" ".join(f"WHEN ({k}) % 11 = 0 THEN '{kind}'" for kind, k, _ in _FAULTS)} END AS kind, {_LINE} AS text
        FROM orders QUALIFY kind IS NOT NULL""",
)
def csv_errors_query(t: Tables):
    """Three files of orders in which five in eleven records have a fault; some hold quoted commas and quotes."""
    path = scratch_path(t.spark, "faults")
    for i in range(3):
        lines = t.orders.where(F.col("o_orderkey") % 3 == i).repartition(1).sortWithinPartitions("o_orderkey").select(F.expr(_LINE).alias("value"))
        header = t.spark.createDataFrame([("key,priority,customer",), ("  ",)], "value string").coalesce(1)
        header.unionByName(lines).coalesce(1).write.text(f"{path}/part={i}")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("priority", T.StringType()), T.StructField("customer", T.LongType())])
    found = csv_errors.csv_errors(t.spark, f"{path}/*", schema)
    return found.withColumn("file", F.regexp_extract("file", "part=([0-9]+)", 1).cast("bigint"))


@query("parquet_roundtrip", "SELECT * FROM part")
def parquet_roundtrip(t: Tables):
    path = scratch_path(t.spark, "roundtrip")
    files.write_parquet(t.part, path)
    return t.spark.read.parquet(path)


@query(
    "profile_manifest",
    f"SELECT (SELECT count(*) FROM part) AS row_count, CAST(6 AS BIGINT) AS n_columns, col_a, col_b, corr FROM ({_corr_sql('part', _PART_NUMBERS)})",
)
def profile_manifest(t: Tables):
    path = scratch_path(t.spark, "manifest")
    manifest = dash.manifest(t.part)
    files.write_json(manifest, path)
    stored = t.spark.read.schema(manifest.schema).json(path)
    rows = stored.select(
        "row_count", F.size("columns").cast("bigint").alias("n_columns"), F.explode("correlations").alias("col_a", "row")
    )
    return rounded(rows.select("row_count", "n_columns", "col_a", F.explode("row").alias("col_b", "corr")))


@query(
    "profile_cache",
    " UNION ALL ".join(
        [
            *_head_sql("events", "event_id", 6, _EVENT_NUMBERS, ("Total Rows", "Total Columns"), True),
            _bar_sql("events", "event_type"),
            _histogram_rows_sql("events", "event_id"),
        ]
    ),
)
def profile_cache(t: Tables):
    """Stored for half of the events; computed again once the file is replaced, and then read as stored."""
    path, table = scratch_path(t.spark, "cache"), scratch_path(t.spark, "cached-events")

    def compute():
        return dash.dashboard(t.spark.read.parquet(table), "simple", ["event_id"])

    def recompute():
        raise AssertionError("the stored result was not used")

    def result(how):
        return cache.cached_result(t.spark, path, "events", "simple", dash.SCHEMA, how, cache.input_version(t.spark, table))

    t.events.where(F.col("event_id") % 2 == 0).write.parquet(table)
    result(compute)
    result(recompute)
    t.events.write.mode("overwrite").parquet(table)
    result(compute)
    return rounded(result(recompute))


@query(
    "records_json",
    "SELECT CAST(to_json(struct_pack(c_custkey := c_custkey, c_name := c_name, c_nationkey := c_nationkey, c_mktsegment := c_mktsegment)) AS VARCHAR) AS record FROM customer",
)
def records_json(t: Tables):
    return files.records_json(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query("row_callback", "SELECT event_id, upper(event_type) AS event_type, value * 2 AS doubled FROM events")
def row_callback(t: Tables):
    def step(rows):
        return rows.assign(event_type=rows["event_type"].str.upper(), doubled=rows["value"] * 2)[["event_id", "event_type", "doubled"]]

    rows = t.events.select("event_id", "event_type", "value")
    return files.map_rows(rows, step, "event_id bigint, event_type string, doubled double")



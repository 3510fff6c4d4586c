"""Scalar functions, arrays and maps on whole test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gaugeboard.functions import text as txt
from gaugeboard.plans.registry import Tables, query


@query("fmt_number", "SELECT o_orderkey, format('{:,}', o_orderkey * 1000) AS shown FROM orders")
def fmt_number(t: Tables):
    return t.orders.select("o_orderkey", txt.fmt_integer(F.col("o_orderkey") * 1000).alias("shown"))


@query(
    "fmt_fixed",
    """SELECT l_partkey, printf('%.2f', avg_price) AS two, printf('%.1f', avg_price) AS one
       FROM (SELECT l_partkey, sum(CAST(l_extendedprice AS DECIMAL(18, 2)))::DOUBLE / count(*) * 0.7390851332::DOUBLE AS avg_price FROM lineitem GROUP BY 1)""",
)
def fmt_fixed(t: Tables):
    total = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    means = t.lineitem.groupBy("l_partkey").agg((total / F.count(F.lit(1)) * 0.7390851332).alias("m"))
    return means.select("l_partkey", txt.fmt_fixed(F.col("m"), 2).alias("two"), txt.fmt_fixed(F.col("m"), 1).alias("one"))


@query(
    "fmt_locale",
    """SELECT p_partkey, format('{:,}', CAST(trunc(p_retailprice * 1000) AS BIGINT) // 1000)
              || regexp_replace(rtrim('.' || lpad(CAST(CAST(round(p_retailprice * 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0'), '0'), '\\.$', '') AS shown
       FROM part""",
)
def fmt_locale(t: Tables):
    return t.part.select("p_partkey", txt.fmt_locale(F.col("p_retailprice")).alias("shown"))


@query(
    "math_ops",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_discount - 0.05) AS gap, floor(l_orderkey / 2)::BIGINT AS half,
              round(l_extendedprice / 1024 / 1024, 2) AS megabytes, greatest(l_quantity, 10) AS at_least, least(l_quantity, 40) AS at_most,
              round((l_extendedprice - l_quantity) / nullif(l_quantity, 0) * 100, 4) AS change
       FROM lineitem""",
)
def math_ops(t: Tables):
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.abs(F.col("l_discount") - 0.05).alias("gap"),
        F.floor(F.col("l_orderkey") / 2).alias("half"),
        txt.megabytes(price).alias("megabytes"),
        F.greatest(q, F.lit(10.0)).alias("at_least"),
        F.least(q, F.lit(40.0)).alias("at_most"),
        F.round(txt.percent_change(q, price), 4).alias("change"),
    )


@query("str_strip_ext", r"SELECT page_id, regexp_replace(url, '\.[^/.]+$', '') AS name FROM pages")
def str_strip_ext(t: Tables):
    return t.pages.select("page_id", txt.strip_extension(F.col("url")).alias("name"))


@query("str_sanitize", "SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9.-]', '_', 'g') AS name FROM pages")
def str_sanitize(t: Tables):
    return t.pages.select("page_id", txt.sanitize_name(F.col("url")).alias("name"))


@query(
    "str_swap_suffix",
    r"""SELECT page_id, regexp_replace(url || '.csv.csv', '\.csv', '.parquet') AS parquet_key,
              regexp_replace(url || '.csv.csv', '\.csv', '-manifest.json') AS manifest_key FROM pages""",
)
def str_swap_suffix(t: Tables):
    name = F.concat("url", F.lit(".csv.csv"))
    return t.pages.select(
        "page_id",
        txt.swap_first(name, ".csv", ".parquet").alias("parquet_key"),
        txt.swap_first(name, ".csv", "-manifest.json").alias("manifest_key"),
    )


@query(
    "str_object_key",
    """SELECT o_orderkey, 'org' || o_custkey || '/project' || o_orderkey || '/' || epoch_ms(o_orderdate) || '-'
              || regexp_replace(o_orderpriority, '[^a-zA-Z0-9.-]', '_', 'g') AS object_key FROM orders""",
)
def str_object_key(t: Tables):
    org, project = F.concat(F.lit("org"), "o_custkey"), F.concat(F.lit("project"), "o_orderkey")
    key = txt.object_key(org, project, F.col("o_orderdate"), F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", key.alias("object_key"))


@query(
    "str_full_name",
    """SELECT d.doc_id AS doc_id, trim(coalesce(lang, '') || ' ' || coalesce(CASE WHEN quality = 1 THEN source END, '')) AS name
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def str_full_name(t: Tables):
    joined = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    last = F.when(F.col("quality") == 1, F.col("source"))
    return joined.select("doc_id", txt.full_name(F.col("lang"), last).alias("name"))


@query("str_initial", "SELECT conv_id, turn, coalesce(nullif(substr(text, 1, 1), ''), 'U') AS initial FROM conversations")
def str_initial(t: Tables):
    return t.conversations.select("conv_id", "turn", txt.initial(F.col("text")).alias("initial"))


@query("str_has_text", "SELECT conv_id, turn, length(trim(text)) > 0 AS has_text FROM conversations")
def str_has_text(t: Tables):
    return t.conversations.select("conv_id", "turn", txt.has_text(F.col("text")).alias("has_text"))


@query(
    "str_template",
    """SELECT c_custkey, 'org_' || c_custkey AS org, 'user_' || c_custkey || '@placeholder.com' AS email,
              c_mktsegment || ' vs ' || c_name AS title FROM customer""",
)
def str_template(t: Tables):
    return t.customer.select(
        "c_custkey",
        F.format_string("org_%d", "c_custkey").alias("org"),
        F.format_string("user_%d@placeholder.com", "c_custkey").alias("email"),
        F.format_string("%s vs %s", "c_mktsegment", "c_name").alias("title"),
    )


@query("json_extract", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_extract(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query(
    "json_nested",
    """SELECT event_id, 'user' || user_id || '@' || event_type AS first_address, user_id FROM events""",
)
def json_nested(t: Tables):
    address = F.concat(F.lit("user"), "user_id", F.lit("@"), "event_type")
    payload = F.to_json(
        F.struct(F.array(F.struct(address.alias("email_address"))).alias("email_addresses"), F.struct("user_id").alias("public_user_data"))
    )
    parsed = "email_addresses array<struct<email_address string>>, public_user_data struct<user_id bigint>"
    rows = t.events.select("event_id", payload.alias("payload")).select("event_id", F.from_json("payload", parsed).alias("p"))
    return rows.select("event_id", F.col("p.email_addresses")[0]["email_address"].alias("first_address"), "p.public_user_data.user_id")


def _exact(name: str):
    """A whole number whose products are exact up to 38 digits; beyond, Spark refuses them."""
    return F.col(name).cast("decimal(20,0)")


_WIDE = "(l_orderkey * 100000007 * CAST(l_partkey + 1 AS BIGINT))"


@query(
    "safe_integer",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
               CASE WHEN {_WIDE} BETWEEN -9007199254740991 AND 9007199254740991 THEN {_WIDE} END AS num,
               CASE WHEN NOT ({_WIDE} BETWEEN -9007199254740991 AND 9007199254740991) THEN CAST({_WIDE} AS VARCHAR) END AS txt FROM lineitem""",
)
def safe_integer(t: Tables):
    wide = _exact("l_orderkey") * F.lit(100000007) * (_exact("l_partkey") + 1)
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", txt.safe_integer(wide).alias("s"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "s.num", "s.txt")


_SQUARE = "(o_orderkey * 1000003 * (o_custkey + 1) * 1009)"


@query(
    "safe_integer_nested",
    f"""SELECT o_orderkey, o_custkey AS first_num, CASE WHEN {_SQUARE} BETWEEN -9007199254740991 AND 9007199254740991 THEN {_SQUARE} END AS second_num,
               CASE WHEN NOT ({_SQUARE} BETWEEN -9007199254740991 AND 9007199254740991) THEN CAST({_SQUARE} AS VARCHAR) END AS second_txt,
               o_orderstatus AS status FROM orders""",
)
def safe_integer_nested(t: Tables):
    square = _exact("o_orderkey") * F.lit(1000003) * (_exact("o_custkey") + 1) * F.lit(1009)
    doc = F.struct(F.array(F.col("o_custkey"), square).alias("numbers"), F.col("o_orderstatus").alias("status"))
    rows = t.orders.select("o_orderkey", doc.alias("doc"))
    rows = rows.select("o_orderkey", txt.safe_integers(F.col("doc"), rows.schema["doc"].dataType).alias("doc"))
    return rows.select(
        "o_orderkey",
        F.col("doc.numbers")[0]["num"].alias("first_num"),
        F.col("doc.numbers")[1]["num"].alias("second_num"),
        F.col("doc.numbers")[1]["txt"].alias("second_txt"),
        "doc.status",
    )


@query(
    "date_ops",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, o_orderdate + INTERVAL 7 DAY AS expires,
              TIMESTAMP '1998-01-01 00:00:00' > o_orderdate + INTERVAL 7 DAY AS expired,
              CAST(month(o_orderdate) AS VARCHAR) || '/' || day(o_orderdate) || '/' || year(o_orderdate) AS shown FROM orders""",
)
def date_ops(t: Tables):
    expires = F.expr("o_orderdate + INTERVAL 7 DAYS")
    now = F.lit(dt.datetime(1998, 1, 1)).cast("timestamp_ntz")
    return t.orders.select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"),
        expires.alias("expires"),
        (now > expires).alias("expired"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("shown"),
    )


_AGE = "date_diff('second', ts, TIMESTAMP '2024-02-01 00:00:00')"


def _ago_sql(unit: str, size: int) -> str:
    n = f"CAST(floor({_AGE} / {size}) AS BIGINT)"
    return f"{n} || ' {unit}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END || ' ago'"


@query(
    "age_bucket",
    f"""SELECT event_id, CASE WHEN {_AGE} < 60 THEN 'less than a minute ago' WHEN {_AGE} < 3600 THEN {_ago_sql('minute', 60)}
               WHEN {_AGE} < 86400 THEN {_ago_sql('hour', 3600)} WHEN {_AGE} < 2592000 THEN {_ago_sql('day', 86400)}
               WHEN {_AGE} < 31536000 THEN {_ago_sql('month', 2592000)} ELSE {_ago_sql('year', 31536000)} END AS age
        FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""",
)
def age_bucket(t: Tables):
    now = F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz")
    rows = t.events.select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    return rows.select("event_id", txt.age_bucket(F.col("ts"), now).alias("age"))


@query(
    "array_ops",
    """SELECT vec_id, CAST(list_count(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n_positive,
              len(list_filter(embedding, lambda x: x > 0.2)) > 0 AS any_large, CAST(embedding[1] AS DOUBLE) AS first,
              CAST(list_sum(list_transform(embedding[1:5], lambda x: CAST(x > 0 AS INTEGER))) AS BIGINT) AS head_positive,
              list_contains(list_transform(embedding, lambda x: floor(x * 10)), 2) AS has_two_tenths FROM embeddings""",
)
def array_ops(t: Tables):
    e = F.col("embedding")
    heads = F.transform(F.slice(e, 1, 5), lambda x: (x > 0).cast("bigint"))
    return t.embeddings.select(
        "vec_id",
        F.size(F.filter(e, lambda x: x > 0)).cast("bigint").alias("n_positive"),
        F.exists(e, lambda x: x > F.lit(0.2)).alias("any_large"),
        F.element_at(e, 1).cast("double").alias("first"),
        F.aggregate(heads, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("head_positive"),
        F.array_contains(F.transform(e, lambda x: F.floor(x * 10)), F.lit(2).cast("bigint")).alias("has_two_tenths"),
    )


@query(
    "map_ops",
    """SELECT event_id, array_to_string(json_keys(props), ',') AS keys, CAST(len(json_keys(props)) AS BIGINT) AS n_entries,
              len(json_keys(props)) > 0 AS not_empty, CAST(props->>'$.k' AS BIGINT) AS first_value FROM events""",
)
def map_ops(t: Tables):
    m = F.from_json("props", "map<string,bigint>")
    rows = t.events.select("event_id", m.alias("m"))
    return rows.select(
        "event_id",
        F.array_join(F.map_keys("m"), ",").alias("keys"),
        F.size("m").cast("bigint").alias("n_entries"),
        (F.size("m") > 0).alias("not_empty"),
        F.map_entries("m")[0]["value"].alias("first_value"),
    )


@query(
    "status_labels",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'processing' ELSE 'pending' END AS badge FROM orders""",
)
def status_labels(t: Tables):
    s = F.col("o_orderstatus")
    badge = F.when(s == "F", "completed").when(s == "P", "processing").otherwise("pending")
    return t.orders.select("o_orderkey", badge.alias("badge"))



"""Profiles, insights and dashboards on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeboard.functions.kinds import decimals_as_numbers
from gaugeboard.operators import insights as ins, profile as prof
from gaugeboard.plans import dashboards as dash
from gaugeboard.plans.registry import ORACLES, Tables, query


def rounded(df, digits: int = 6, only: tuple[str, ...] | None = None):
    """Round double columns, so that summation order does not show."""
    names = only or [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


# ---- shape and summaries ---------------------------------------------------


@query(
    "dataset_shape",
    "SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count FROM lineitem",
)
def dataset_shape(t: Tables):
    return prof.dataset_shape(t.lineitem)


_EVENT_SCHEMA = [
    ("event_id", "bigint", "numeric"),
    ("ts", "timestamp_ntz", "temporal"),
    ("user_id", "bigint", "numeric"),
    ("event_type", "string", "categorical"),
    ("value", "double", "numeric"),
    ("props", "string", "categorical"),
]


@query(
    "schema_listing",
    " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS ordinal, '{n}' AS \"column\", '{ty}' AS type, '{k}' AS kind, count({n}) AS n_values FROM events"
        for i, (n, ty, k) in enumerate(_EVENT_SCHEMA)
    ),
)
def schema_listing(t: Tables):
    return prof.schema_listing(t.events)


@query(
    "top_categories",
    """SELECT event_type AS category, count(event_type) AS "count" FROM events
       GROUP BY event_type ORDER BY 2 DESC, 1 LIMIT 10""",
)
def top_categories(t: Tables):
    return prof.top_categories(t.events, "event_type")


@query(
    "top_categories_many",
    """SELECT p_name AS category, count(p_name) AS "count" FROM part
       GROUP BY p_name ORDER BY 2 DESC, 1 LIMIT 10""",
)
def top_categories_many(t: Tables):
    return prof.top_categories(t.part, "p_name")


@query(
    "column_summary",
    """SELECT round(sum(l_extendedprice), 2) AS sum, round(avg(l_extendedprice), 6) AS avg,
              min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(l_extendedprice) AS count
       FROM lineitem""",
)
def column_summary(t: Tables):
    out = prof.column_summary(t.lineitem, "l_extendedprice")
    return rounded(rounded(out, 6, ("avg",)), 2, ("sum",))


_LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


@query(
    "numeric_moments",
    " UNION ALL ".join(
        f"""SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS "column", round(avg({c}), 6) AS mean,
            round(coalesce(stddev_samp({c}), 0), 6) AS std, CAST(max({c}) AS DOUBLE) AS max, CAST(min({c}) AS DOUBLE) AS min
            FROM lineitem"""
        for i, c in enumerate(_LINE_NUMBERS)
    ),
)
def numeric_moments(t: Tables):
    return rounded(prof.numeric_moments(t.lineitem))


def _describe_sql(table: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns):
        number = kind == "numeric"
        num = lambda e: e if number else "CAST(NULL AS DOUBLE)"
        text = lambda e: "CAST(NULL AS VARCHAR)" if number else e
        parts.append(
            f"""SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS "column", count({c}) AS n_values,
                {num(f"round(avg({c}), 6)")} AS mean, {num(f"round(stddev_samp({c}), 6)")} AS std,
                {num(f"CAST(min({c}) AS DOUBLE)")} AS min, {num(f"CAST(max({c}) AS DOUBLE)")} AS max,
                {num(f"round(CAST(median({c}) AS DOUBLE), 6)")} AS median,
                {text(f"min({c})")} AS min_text, {text(f"max({c})")} AS max_text FROM {table}"""
        )
    return " UNION ALL ".join(parts)


_PART_COLUMNS = [
    ("p_partkey", "numeric"),
    ("p_name", "text"),
    ("p_brand", "text"),
    ("p_type", "text"),
    ("p_size", "numeric"),
    ("p_retailprice", "numeric"),
]


@query("describe", _describe_sql("part", _PART_COLUMNS))
def describe(t: Tables):
    return rounded(prof.describe(t.part))


@query("describe_decimals", _describe_sql("part", _PART_COLUMNS))
def describe_decimals(t: Tables):
    """Prices as decimals, which count as numbers on request."""
    priced = t.part.withColumn("p_retailprice", F.col("p_retailprice").cast("decimal(18,6)"))
    return rounded(prof.describe(decimals_as_numbers(priced)))


def _corr_sql(table: str, cols: list[str]) -> str:
    pairs = [(a, b) for a in cols for b in cols]
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END, 6) AS corr
            FROM {table}"""
        for a, b in pairs
    )


_PART_NUMBERS = ["p_partkey", "p_size", "p_retailprice"]


@query("pearson_matrix", _corr_sql("lineitem", _LINE_NUMBERS))
def pearson_matrix(t: Tables):
    return rounded(prof.pearson_matrix(t.lineitem))


@query(
    "chart_line",
    """WITH p AS (SELECT epoch_us(ts) / 1e6 AS x, value AS y FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
            b AS (SELECT min(x) AS lo, max(x) AS hi FROM p),
            n AS (SELECT CAST(least(floor((200.0::DOUBLE * (x - lo)) / (hi - lo)), 199) AS BIGINT) AS bin, x, y FROM p, b),
            r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY x, y) AS a, row_number() OVER (PARTITION BY bin ORDER BY x DESC, y DESC) AS b,
                         row_number() OVER (PARTITION BY bin ORDER BY y, x) AS c, row_number() OVER (PARTITION BY bin ORDER BY y DESC, x DESC) AS d FROM n)
       SELECT DISTINCT bin, round(x, 6) AS x, y FROM r WHERE a = 1 OR b = 1 OR c = 1 OR d = 1""",
)
def chart_line(t: Tables):
    """All events as a line 200 pixels wide."""
    return rounded(prof.line_points(t.events, "ts", "value", 200), 6, ("x",))


_BAND = "l_linenumber <= 2"


@query(
    "pearson_offsets",
    f"""WITH c AS (SELECT corr(l_discount, l_tax) FILTER (WHERE {_BAND}) AS ab, corr(l_discount, l_quantity) FILTER (WHERE {_BAND}) AS bq FROM lineitem)
        SELECT w.n AS width, round(ab, 6) AS far_pair, round(bq, 6) AS gap_pair FROM c CROSS JOIN (SELECT 3::BIGINT AS n UNION ALL SELECT 12::BIGINT) w""",
)
def pearson_offsets(t: Tables):
    """Columns with large offsets where the other has gaps; alike for few columns and for many."""
    here = F.col("l_linenumber") <= 2
    far = F.when(here, F.col("l_tax") + 1_000_000).otherwise(F.col("l_discount") - 1_000_000)
    df = t.lineitem.select(
        far.alias("far"), F.when(here, F.col("l_discount") - 5_000).alias("gaps"), "l_quantity",
        *[(F.col("l_quantity") * i + F.col("l_tax")).alias(f"more{i}") for i in range(9)],
    )
    out = None
    for width in (3, 12):
        matrix = prof.pearson_matrix(df, df.columns[:width]).where("col_a = 'gaps' AND col_b IN ('far', 'l_quantity')")
        picked = [F.max(F.when(F.col("col_b") == c, F.col("corr"))).alias(name) for c, name in (("far", "far_pair"), ("l_quantity", "gap_pair"))]
        row = matrix.agg(*picked).select(F.lit(width).cast("long").alias("width"), "far_pair", "gap_pair")
        out = row if out is None else out.unionByName(row)
    return rounded(out)


@query("corr_map", _corr_sql("part", _PART_NUMBERS))
def corr_map(t: Tables):
    nested = prof.corr_map(t.part)
    rows = nested.select(F.explode("correlations").alias("col_a", "row")).select("col_a", F.explode("row").alias("col_b", "corr"))
    return rounded(rows)


def _histogram_sql(table: str, col: str, bins: int = 20) -> str:
    return f"""
        WITH b AS (SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi FROM {table}),
        c AS (SELECT CAST(CASE WHEN lo = hi THEN 0 ELSE least(floor(({bins}.0::DOUBLE * ({col} - lo)) / (hi - lo)), {bins - 1}) END AS BIGINT) AS bin,
                     count(*) AS n FROM {table}, b WHERE {col} IS NOT NULL GROUP BY 1),
        s AS (SELECT CAST(range AS BIGINT) AS bin FROM range({bins}))
        SELECT s.bin AS bin, round(lo + s.bin * ((hi - lo) / {bins}), 6) AS lo,
               round(CASE WHEN lo = hi THEN hi ELSE lo + (s.bin + 1) * ((hi - lo) / {bins}) END, 6) AS hi,
               coalesce(c.n, 0) AS "count"
        FROM s CROSS JOIN b LEFT JOIN c ON s.bin = c.bin WHERE s.bin < CASE WHEN lo = hi THEN 1 ELSE {bins} END"""


@query("histogram", _histogram_sql("lineitem", "l_extendedprice"))
def histogram(t: Tables):
    return rounded(prof.histogram(t.lineitem, "l_extendedprice"))


@query("histogram_events", _histogram_sql("events", "value"))
def histogram_events(t: Tables):
    return rounded(prof.histogram(t.events, "value"))


# ---- chart data ------------------------------------------------------------


def _pie_sql(table: str, category: str, value: str, n: int = 5) -> str:
    return f"""
        WITH s AS (SELECT CAST({category} AS VARCHAR) AS category, sum({value}) AS total FROM {table} GROUP BY 1),
        r AS (SELECT *, row_number() OVER (ORDER BY total DESC NULLS LAST, category) AS rn, sum(total) OVER () AS everything FROM s)
        SELECT CASE WHEN rn <= {n} THEN category ELSE 'other' END AS category, sum(total) AS total,
               sum(total) / max(everything) AS share
        FROM r GROUP BY CASE WHEN rn <= {n} THEN category ELSE 'other' END, rn > {n}"""


@query(
    "pie_share",
    f"SELECT category, round(total, 2) AS total, round(share, 6) AS share FROM ({_pie_sql('lineitem JOIN part ON l_partkey = p_partkey', 'p_brand', 'l_extendedprice')})",
)
def pie_share(t: Tables):
    sold = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rounded(rounded(prof.pie_share(sold, "p_brand", "l_extendedprice"), 6, ("share",)), 2, ("total",))


@query("pie_first5", "SELECT p_partkey, p_retailprice AS y FROM part ORDER BY p_partkey LIMIT 5")
def pie_first5(t: Tables):
    return prof.pie_first(t.part, ["p_partkey"], "p_retailprice")


@query(
    "chart_bar_points",
    "SELECT event_id, event_type AS x, value AS y FROM events ORDER BY event_id LIMIT 1000",
)
def chart_bar_points(t: Tables):
    return prof.chart_points(t.events, ["event_id"], "event_type", "value")


@query(
    "chart_line_points",
    "SELECT o_orderkey, o_orderdate AS x, o_totalprice AS y FROM orders ORDER BY o_orderkey LIMIT 1000",
)
def chart_line_points(t: Tables):
    return prof.chart_points(t.orders, ["o_orderkey"], "o_orderdate", "o_totalprice")


@query(
    "chart_bar_agg",
    "SELECT event_type AS x, round(sum(value), 2) AS y FROM events GROUP BY event_type",
)
def chart_bar_agg(t: Tables):
    return rounded(prof.chart_bar_agg(t.events, "event_type", "value"), 2)


@query(
    "scatter_points",
    "SELECT p_partkey, p_partkey AS x, CAST(p_size AS INTEGER) AS y, p_retailprice AS z, p_retailprice AS color FROM part",
)
def scatter_points(t: Tables):
    return prof.scatter_points(t.part, ["p_partkey"])


def _grid_sql(table: str, x: str, y: str, bins: int = 20) -> str:
    def bin_of(c: str, i: int) -> str:
        return f"CAST(CASE WHEN lo{i} = hi{i} THEN 0 ELSE least(floor(({bins}.0::DOUBLE * ({c} - lo{i})) / (hi{i} - lo{i})), {bins - 1}) END AS BIGINT)"

    return f"""
        WITH b AS (SELECT CAST(min({x}) AS DOUBLE) AS lo0, CAST(max({x}) AS DOUBLE) AS hi0,
                          CAST(min({y}) AS DOUBLE) AS lo1, CAST(max({y}) AS DOUBLE) AS hi1 FROM {table})
        SELECT {bin_of(x, 0)} AS x_bin, {bin_of(y, 1)} AS y_bin, count(*) AS "count" FROM {table}, b GROUP BY 1, 2"""


@query("scatter_grid", _grid_sql("lineitem", "l_quantity", "l_extendedprice"))
def scatter_grid(t: Tables):
    return prof.scatter_grid(t.lineitem, "l_quantity", "l_extendedprice")


@query("preview_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000")
def preview_rows(t: Tables):
    return prof.preview(t.orders, ["o_orderkey"])


@query(
    "kpis_simple",
    """SELECT CAST(0 AS BIGINT) AS ordinal, 'Total Rows' AS label, format('{:,}', count(*)) AS value FROM lineitem
       UNION ALL SELECT 1, 'Total Columns', '11' FROM (SELECT count(*) FROM lineitem)""",
)
def kpis_simple(t: Tables):
    return prof.kpis(t.lineitem)


@query(
    "kpis_ml",
    """SELECT CAST(0 AS BIGINT) AS ordinal, 'Dataset Size' AS label, CAST(count(*) AS VARCHAR) AS value FROM lineitem
       UNION ALL SELECT 1, 'Features', '11' FROM (SELECT count(*) FROM lineitem)""",
)
def kpis_ml(t: Tables):
    return prof.kpis(t.lineitem, "ml")


@query(
    "kpis_view",
    """SELECT CAST(0 AS BIGINT) AS ordinal, 'Total Rows' AS label, CAST(count(*) AS VARCHAR) AS value FROM orders
       UNION ALL SELECT 1, 'Columns', '6' FROM (SELECT count(*) FROM orders)
       UNION ALL SELECT 2, 'Dataset Name', 'Analysis Report' FROM (SELECT count(*) FROM orders)""",
)
def kpis_view(t: Tables):
    return prof.kpis(t.orders, "view")


# ---- insights --------------------------------------------------------------

_EVENT_NUMBERS = ["event_id", "user_id", "value"]


def _moments_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS std, CAST(max({c}) AS DOUBLE) AS max FROM {table}"
        for i, c in enumerate(cols)
    )


def _halves_sql(table: str, key: str, cols: list[str]) -> str:
    means = " UNION ALL ".join(
        f"""SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS "column", max(n) AS n,
            avg(CASE WHEN pos <= n // 2 THEN {c} END) AS first_mean, avg(CASE WHEN pos > n // 2 THEN {c} END) AS second_mean FROM p"""
        for i, c in enumerate(cols)
    )
    return f"""
        (WITH p AS (SELECT *, row_number() OVER (ORDER BY {key}) AS pos, count(*) OVER () AS n FROM {table}), m AS ({means})
         SELECT ordinal, "column", first_mean, second_mean, (second_mean - first_mean) / nullif(first_mean, 0) * 100 AS pct_change
         FROM m WHERE n > 10)"""


def _insights_sql(table: str, key: str, cols: list[str]) -> str:
    """Insight rows (ordinal, type, title, description, severity) of a table."""
    return f"""
        (WITH found AS (
            SELECT 0 AS rule, ordinal, 'outlier' AS type, 'Extreme Value in ' || "column" AS title,
                   'The maximum value (' || printf('%.2f', max) || ') is significantly higher (> 3σ) than the average (' || printf('%.2f', mean) || ').' AS description,
                   'warning' AS severity
            FROM ({_moments_sql(table, cols)}) WHERE std > 0 AND (max - mean) / std > 3
            UNION ALL
            SELECT 1, ordinal, 'trend', CASE WHEN pct_change > 0 THEN 'Upward' ELSE 'Downward' END || ' Trend in ' || "column",
                   'Values have ' || CASE WHEN pct_change > 0 THEN 'increased' ELSE 'decreased' END || ' by approximately '
                   || printf('%.1f', abs(pct_change)) || '% from the first half to the second half of the dataset.',
                   CASE WHEN pct_change > 0 THEN 'positive' ELSE 'info' END
            FROM {_halves_sql(table, key, cols)} WHERE abs(pct_change) > 20),
        listed AS (
            SELECT * FROM found UNION ALL
            SELECT 2, 0, 'general', 'Consistent Data', 'No significant outliers or strong trends detected. The data appears stable.', 'info'
            FROM (SELECT count(*) AS n FROM found) WHERE n = 0)
        SELECT CAST(row_number() OVER (ORDER BY rule, ordinal) - 1 AS BIGINT) AS ordinal, type, title, description, severity
        FROM listed ORDER BY rule, ordinal LIMIT 5)"""


@query(
    "insight_outliers",
    f"""SELECT ordinal, "column", round(mean, 6) AS mean, round(std, 6) AS std, max, round((max - mean) / std, 6) AS z_max
        FROM ({_moments_sql("events", _EVENT_NUMBERS)}) WHERE std > 0 AND (max - mean) / std > 3""",
)
def insight_outliers(t: Tables):
    return rounded(ins.outlier_insights(t.events))


@query(
    "insight_trends",
    f"""SELECT ordinal, "column", round(first_mean, 6) AS first_mean, round(second_mean, 6) AS second_mean,
               round(pct_change, 6) AS pct_change, CASE WHEN pct_change > 0 THEN 'Upward' ELSE 'Downward' END AS direction
        FROM {_halves_sql("events", "event_id", _EVENT_NUMBERS)} WHERE abs(pct_change) > 20""",
)
def insight_trends(t: Tables):
    return rounded(ins.trend_insights(t.events, ["event_id"]))


@query(
    "insight_trends_ties",
    f"""SELECT ordinal, "column", round(first_mean, 6) AS first_mean, round(second_mean, 6) AS second_mean, round(pct_change, 6) AS pct_change,
               CASE WHEN pct_change > 0 THEN 'Upward' ELSE 'Downward' END AS direction
        FROM {_halves_sql("events", "user_id, event_id", _EVENT_NUMBERS)} WHERE abs(pct_change) > 1""",
)
def insight_trends_ties(t: Tables):
    """Users have many events; the event's id breaks their ties."""
    return rounded(ins.trend_insights(t.events, ["user_id", "event_id"], percent=1.0))


@query(
    "insight_fallback",
    f"""SELECT ordinal, type, title, description, severity
        FROM {_insights_sql("(SELECT s_suppkey, s_name, s_nationkey FROM supplier)", "s_name", ["s_nationkey"])} WHERE type = 'general'""",
)
def insight_fallback(t: Tables):
    suppliers = t.supplier.select(F.col("s_suppkey").cast("string").alias("s_suppkey"), "s_name", "s_nationkey")
    return ins.fallback_insight(suppliers, ["s_name"])


@query("insights", f"SELECT * FROM {_insights_sql('events', 'event_id', _EVENT_NUMBERS)}")
def insights(t: Tables):
    return ins.insights(t.events, ["event_id"])


@query(
    "insight_correlation",
    f"SELECT * FROM ({_corr_sql('part', _PART_NUMBERS)}) WHERE col_a < col_b AND abs(corr) >= 0.4",
)
def insight_correlation(t: Tables):
    return rounded(ins.correlation_insights(t.part, 0.4))


@query(
    "insight_correlation_text",
    f"""SELECT 'correlation' AS type, 'Strong Correlation: ' || col_a || ' and ' || col_b AS title, 'info' AS severity,
               'Values of ' || col_b || ' tend to ' || CASE WHEN corr > 0 THEN 'rise' ELSE 'fall' END || ' as ' || col_a || ' rises (r = ' || format('{{:.2f}}', corr) || ').' AS description
        FROM ({_corr_sql('part', _PART_NUMBERS)}) WHERE col_a < col_b AND abs(corr) >= 0.4""",
)
def insight_correlation_text(t: Tables):
    return ins.correlation_records(t.part, 0.4)


# ---- dashboards ------------------------------------------------------------

_EMPTY = {name: f"CAST(NULL AS {'VARCHAR' if ty == 'string' else ty})" for name, ty in dash._COLUMNS}


def _row_sql(source: str, **values: str) -> str:
    cols = ", ".join(f"CAST({values[n]} AS {'VARCHAR' if ty == 'string' else ty}) AS {n}" if n in values else f"{_EMPTY[n]} AS {n}" for n, ty in dash._COLUMNS)
    return f"SELECT {cols} FROM {source}"


def _head_sql(table: str, key: str, n_cols: int, numbers: list[str], labels: tuple[str, str], formatted: bool) -> list[str]:
    n_text = "format('{:,}', count(*))" if formatted else "count(*)"
    return [
        _row_sql(f"(SELECT {n_text} AS v FROM {table})", section="'kpi'", ordinal="0", title=f"'{labels[0]}'", text="v"),
        _row_sql(f"(SELECT count(*) FROM {table})", section="'kpi'", ordinal="1", title=f"'{labels[1]}'", text=f"'{n_cols}'"),
        _row_sql(
            _insights_sql(table, key, numbers),
            section="'insight'", series="type", title="title", ordinal="ordinal", text="description", x_label="severity",
        ),
    ]


def _bar_sql(table: str, category: str, **grid: str) -> str:
    top = f"""(SELECT {category} AS c, count({category}) AS n, row_number() OVER (ORDER BY count({category}) DESC, {category}) - 1 AS rk
               FROM {table} GROUP BY {category} ORDER BY 2 DESC, 1 LIMIT 10)"""
    return _row_sql(
        top, section="'chart'", chart_id="'chart-1'", chart_type="'bar'", title=f"'Top 10 {category}'", ordinal="rk", x_label="c", y="n", **grid
    )


def _histogram_rows_sql(table: str, value: str, **grid: str) -> str:
    return _row_sql(
        f"({_histogram_sql(table, value)})",
        section="'chart'", chart_id="'chart-2'", chart_type="'histogram'", title=f"'Distribution of {value}'",
        ordinal="bin", x_num="lo", y='"count"', **grid,
    )


_FIRST = {"grid_x": "0", "grid_y": "0", "grid_w": "6", "grid_h": "4"}
_SECOND = {**_FIRST, "grid_x": "6"}
_SIMPLE_HEAD = _head_sql("events", "event_id", 6, _EVENT_NUMBERS, ("Total Rows", "Total Columns"), True)


@query(
    "dashboard_simple",
    " UNION ALL ".join([*_SIMPLE_HEAD, _bar_sql("events", "event_type"), _histogram_rows_sql("events", "event_id")]),
)
def dashboard_simple(t: Tables):
    return rounded(dash.dashboard(t.events, "simple", ["event_id"]))


@query(
    "dashboard_document",
    f"""WITH d AS ({ORACLES["dashboard_simple"]})
        SELECT 'simple' AS layout, (SELECT count(*) FROM d WHERE section = 'kpi') AS n_kpis, (SELECT count(*) FROM d WHERE section = 'insight') AS n_insights,
               chart_id AS id, chart_type AS type, title, count(*) AS n_points, CAST(sum(y) AS DOUBLE) AS total FROM d WHERE section = 'chart' GROUP BY ALL""",
)
def dashboard_document(t: Tables):
    """The nested document, with the data of each chart added up."""
    found = dash.document(dash.dashboard(t.events, "simple", ["event_id"]), "simple")
    sizes = [F.size(part).cast("bigint").alias(f"n_{part}") for part in ("kpis", "insights")]
    total = F.aggregate("data", F.lit(0.0), lambda done, point: done + point.getField("y")).alias("total")
    return found.select("layout", *sizes, F.inline("charts")).select(
        "layout", "n_kpis", "n_insights", "id", "type", "title", F.size("data").cast("bigint").alias("n_points"), total
    )


@query(
    "dashboard_ml",
    " UNION ALL ".join(
        [
            *_head_sql("part", "p_partkey", 6, _PART_NUMBERS, ("Dataset Size", "Features"), False),
            _row_sql(
                f"({_grid_sql('part', 'p_partkey', 'p_size')})",
                section="'chart'", chart_id="'ml-scatter'", chart_type="'scatter'", title="'Correlation: p_partkey vs p_size'",
                series="y_bin", ordinal="y_bin", x_num="x_bin", y='"count"',
            ),
            _row_sql(
                f"({_corr_sql('part', _PART_NUMBERS)})",
                section="'chart'", chart_id="'ml-heatmap'", chart_type="'heatmap'", title="'Correlation matrix'",
                series="col_a", x_label="col_b", y="corr",
            ),
        ]
    ),
)
def dashboard_ml(t: Tables):
    return rounded(dash.dashboard(t.part, "ml", ["p_partkey"]))


@query(
    "dashboard_powerbi",
    " UNION ALL ".join(
        [
            *_SIMPLE_HEAD,
            _bar_sql("events", "event_type", **_FIRST),
            _histogram_rows_sql("events", "event_id", **_SECOND),
            _row_sql(
                f"({_pie_sql('events', 'event_type', 'event_id')})",
                section="'chart'", chart_id="'chart-3'", chart_type="'pie'", title="'event_id by event_type'",
                x_label="category", x_num="round(share, 6)", y="total",
            ),
        ]
    ),
)
def dashboard_powerbi(t: Tables):
    return rounded(dash.dashboard(t.events, "powerbi", ["event_id"]))


def _file_profile_sql(table: str, key: str, columns: list[tuple[str, str]], types: list[str]) -> str:
    schema = " UNION ALL ".join(
        f"SELECT 'schema' AS section, CAST({i} AS BIGINT) AS ordinal, '{c}' AS name, 'values' AS stat, CAST(count({c}) AS DOUBLE) AS num, '{ty}' AS text FROM {table}"
        for i, ((c, _), ty) in enumerate(zip(columns, types))
    )
    described = f"({_describe_sql(table, columns)})"
    numbers = " UNION ALL ".join(
        f"SELECT 'summary', ordinal, \"column\", '{s}', {s}, CAST(NULL AS VARCHAR) FROM {described} WHERE {s} IS NOT NULL"
        for s in ("mean", "std", "min", "max", "median")
    )
    texts = " UNION ALL ".join(
        f"SELECT 'summary', ordinal, \"column\", '{s}', CAST(NULL AS DOUBLE), {s} FROM {described} WHERE {s} IS NOT NULL"
        for s in ("min_text", "max_text")
    )
    fields = ", ".join(f"{c} := {c}" for c, _ in columns)
    preview = f"""SELECT 'preview', row_number() OVER (ORDER BY {key}) - 1, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE),
                  CAST(to_json(struct_pack({fields})) AS VARCHAR) FROM (SELECT * FROM {table} ORDER BY {key} LIMIT 1000)"""
    return f"{schema} UNION ALL {numbers} UNION ALL {texts} UNION ALL {preview}"


@query(
    "file_profile",
    _file_profile_sql("part", "p_partkey", _PART_COLUMNS, ["bigint", "string", "string", "string", "int", "double"]),
)
def file_profile(t: Tables):
    return rounded(dash.file_profile(t.part, ["p_partkey"]))

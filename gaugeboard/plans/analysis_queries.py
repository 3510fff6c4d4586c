"""Business analyses on the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from gaugeboard.operators.ordered import running_totals
from gaugeboard.operators.analyses import anomaly, customers as cust, descriptive as desc, regression as reg, timeseries as ts
from gaugeboard.plans.profile_queries import _LINE_NUMBERS, _histogram_sql, rounded
from gaugeboard.plans.registry import Tables, query

# ---- descriptive -----------------------------------------------------------


@query(
    "an_descriptive",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
            round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q1, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median,
            round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q3, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"""
        for c in _LINE_NUMBERS
    ),
)
def an_descriptive(t: Tables):
    return rounded(desc.descriptive(t.lineitem))


@query(
    "an_mode",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS mode, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL
            GROUP BY {c} ORDER BY n DESC, mode LIMIT 1)"""
        for c in _LINE_NUMBERS
    ),
)
def an_mode(t: Tables):
    return desc.modes(t.lineitem)


_SPEARMAN_COLS = [(a, b) for i, a in enumerate(_LINE_NUMBERS) for b in _LINE_NUMBERS[i + 1 :]]


def _spearman_sql(table: str, pairs) -> str:
    rank = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(ra, rb), 6) AS corr FROM (SELECT {rank(a)} AS ra, {rank(b)} AS rb FROM {table})"
        for a, b in pairs
    )


@query("an_spearman", _spearman_sql("lineitem", _SPEARMAN_COLS))
def an_spearman(t: Tables):
    return rounded(desc.spearman_matrix(t.lineitem))


_GAPS = """(SELECT user_id, value, CASE WHEN event_type = 'purchase' THEN value END AS paid, CASE WHEN event_type = 'purchase' THEN user_id END AS buyer,
             CASE WHEN event_type <> 'view' THEN value END AS acted FROM events)"""
_GAP_COLS = ["user_id", "value", "paid", "buyer", "acted"]


@query(
    "an_spearman_gaps",
    " UNION ALL ".join(
        _spearman_sql(f"(SELECT * FROM {_GAPS} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)", [(a, b)])
        for i, a in enumerate(_GAP_COLS)
        for b in _GAP_COLS[i + 1 :]
    ),
)
def an_spearman_gaps(t: Tables):
    """Columns that only some events have; each pair is ranked over the rows that have both."""
    bought = F.col("event_type") == "purchase"
    rows = t.events.select(
        "user_id",
        "value",
        F.when(bought, F.col("value")).alias("paid"),
        F.when(bought, F.col("user_id")).alias("buyer"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("acted"),
    )
    return rounded(desc.spearman_matrix(rows, _GAP_COLS))


@query("an_distribution", _histogram_sql("documents", "n_chars"))
def an_distribution(t: Tables):
    from gaugeboard.operators.profile import histogram

    return rounded(histogram(t.documents, "n_chars"))


@query(
    "an_quantiles",
    " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS prob, round(quantile_cont(value, {p}), 6) AS value FROM events" for p in (i / 10 for i in range(11))
    ),
)
def an_quantiles(t: Tables):
    return rounded(desc.quantile_table(t.events, "value"))


# ---- time series -----------------------------------------------------------

_MONTHS_SQL = """(WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(o_totalprice * 0.91374659::DOUBLE) AS y FROM orders GROUP BY 1),
          c AS (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM m)
     SELECT c.period AS period, coalesce(y, 0) AS y, datediff('month', min(c.period) OVER (), c.period) AS t FROM c LEFT JOIN m ON c.period = m.period)"""


def _series_sql(key: str) -> str:
    return f"""(WITH m AS (SELECT {key}, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(o_totalprice * 0.91374659::DOUBLE) AS y FROM orders GROUP BY 1, 2),
          c AS (SELECT {key}, CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM m GROUP BY 1)
     SELECT c.{key} AS {key}, c.period AS period, coalesce(y, 0) AS y, datediff('month', min(c.period) OVER (PARTITION BY c.{key}), c.period) AS t
     FROM c LEFT JOIN m ON c.period = m.period AND c.{key} = m.{key})"""


_SERIES_SQL = _series_sql("o_orderpriority")


# Prices in another currency; the many decimals keep sums off rounding borders.
RATE = 0.91374659


def _months(t: Tables):
    return ts.periods(t.orders, "o_orderdate", F.col("o_totalprice") * RATE)


def _series(t: Tables):
    return ts.periods(t.orders, "o_orderdate", F.col("o_totalprice") * RATE, series=["o_orderpriority"])


@query("an_ts_periods", f"SELECT period, round(y, 2) AS y, t FROM {_MONTHS_SQL}")
def an_ts_periods(t: Tables):
    return rounded(_months(t), 2)


@query(
    "an_ts_moving_avg",
    f"""SELECT period, round(y, 2) AS y, t, round(avg(y) OVER (ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS moving_avg
        FROM {_MONTHS_SQL}""",
)
def an_ts_moving_avg(t: Tables):
    return rounded(ts.moving_average(_months(t)), 2)


@query(
    "an_ts_growth",
    f"""SELECT o_orderpriority, period, t, round(y, 2) AS y, round(y - lag(y) OVER w, 2) AS delta,
               round((y - lag(y) OVER w) / nullif(lag(y) OVER w, 0), 6) AS growth FROM {_SERIES_SQL} WINDOW w AS (PARTITION BY o_orderpriority ORDER BY t)""",
)
def an_ts_growth(t: Tables):
    out = ts.growth(_series(t), ["o_orderpriority"])
    return rounded(rounded(out, 2, ("y", "delta")), 6, ("growth",))


@query(
    "an_ts_gaps",
    f"""SELECT o_custkey, period, t, round(y, 2) AS y, round(y - lag(y) OVER w, 2) AS delta,
               round(lag(y, 12) OVER w, 2) AS year_before FROM {_series_sql("o_custkey")} WINDOW w AS (PARTITION BY o_custkey ORDER BY t)""",
)
def an_ts_gaps(t: Tables):
    """Customers order in few months; the months between them count as months without sales."""
    series = ["o_custkey"]
    p = ts.periods(t.orders, "o_orderdate", F.col("o_totalprice") * RATE, series=series)
    order = Window.partitionBy(*series).orderBy("t")
    return rounded(ts.growth(p, series).withColumn("year_before", F.lag("y", 12).over(order)).drop("growth"), 2)


@query(
    "an_ts_trend",
    f"""SELECT o_orderpriority, round(regr_slope(y, t), 2) AS slope, round(regr_intercept(y, t), 2) AS intercept, count(*) AS n
        FROM {_SERIES_SQL} GROUP BY 1""",
)
def an_ts_trend(t: Tables):
    return rounded(ts.trend_line(_series(t), ["o_orderpriority"]), 2)


_DECOMPOSED_SQL = f"""
    (WITH p AS (SELECT *, month(period) AS place FROM {_MONTHS_SQL}),
     w AS (SELECT *, sum(y) OVER (ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS wide,
                  sum(y) OVER (ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS inside,
                  count(*) OVER (ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS n FROM p),
     tr AS (SELECT period, y, t, place, CASE WHEN n = 13 THEN (inside + (wide - inside) / 2) / 12 END AS trend FROM w),
     raw AS (SELECT place, avg(y - trend) AS r FROM tr GROUP BY 1),
     s AS (SELECT place, r - avg(r) OVER () AS seasonal FROM raw)
     SELECT tr.*, s.seasonal FROM tr JOIN s ON tr.place = s.place)"""


@query("an_ts_seasonality", f"SELECT DISTINCT place, round(seasonal, 2) AS seasonal FROM {_DECOMPOSED_SQL}")
def an_ts_seasonality(t: Tables):
    return rounded(ts.seasonality(_months(t)), 2)


@query(
    "an_ts_decompose",
    f"""SELECT period, t, round(y, 2) AS y, round(trend, 2) AS trend, round(seasonal, 2) AS seasonal,
               round(y - trend - seasonal, 2) AS residual FROM {_DECOMPOSED_SQL}""",
)
def an_ts_decompose(t: Tables):
    return rounded(ts.decompose(_months(t)), 2)


@query(
    "an_forecast_ses",
    f"""WITH RECURSIVE p AS (SELECT * FROM {_SERIES_SQL}),
        f AS (SELECT o_orderpriority, t, y AS level FROM p WHERE t = 0
              UNION ALL SELECT p.o_orderpriority, p.t, 0.3::DOUBLE * p.y + 0.7::DOUBLE * f.level
              FROM f JOIN p ON p.o_orderpriority = f.o_orderpriority AND p.t = f.t + 1)
        SELECT o_orderpriority, round(arg_max(level, t), 2) AS forecast FROM f GROUP BY 1""",
)
def an_forecast_ses(t: Tables):
    return rounded(ts.exponential_smoothing(_series(t), ["o_orderpriority"]), 2)


@query(
    "an_forecast_naive",
    f"""WITH p AS (SELECT * FROM {_SERIES_SQL}), l AS (SELECT o_orderpriority, max(t) AS last FROM p GROUP BY 1)
        SELECT l.o_orderpriority AS o_orderpriority, CAST(s.range AS BIGINT) AS step, round(p.y, 2) AS forecast
        FROM l CROSS JOIN range(1, 4) s LEFT JOIN p ON p.o_orderpriority = l.o_orderpriority AND p.t = l.last + s.range - 12""",
)
def an_forecast_naive(t: Tables):
    return rounded(ts.seasonal_naive(_series(t), ["o_orderpriority"]), 2)


@query(
    "an_forecast_linear",
    f"""WITH m AS (SELECT o_orderpriority, regr_slope(y, t) AS slope, regr_intercept(y, t) AS icept, max(t) AS last FROM {_SERIES_SQL} GROUP BY 1)
        SELECT o_orderpriority, CAST(s.range AS BIGINT) AS step, round(icept + slope * (last + s.range), 2) AS forecast
        FROM m CROSS JOIN range(1, 4) s""",
)
def an_forecast_linear(t: Tables):
    return rounded(ts.linear_forecast(_series(t), ["o_orderpriority"]), 2)


# ---- customers -------------------------------------------------------------

_NOW = dt.date(2001, 9, 1)


def _features(t: Tables):
    sales = t.orders.select("o_custkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    features = cust.rfm_features(sales, "o_custkey", "o_orderdate", "price", F.lit(_NOW))
    return features.withColumn("monetary", F.col("monetary").cast("double"))


@query(
    "an_rfm",
    """WITH f AS (SELECT o_custkey, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-09-01') AS recency, count(*) AS frequency,
                         CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS monetary FROM orders GROUP BY 1)
       SELECT o_custkey, recency, frequency, monetary, ntile(5) OVER (ORDER BY recency DESC, o_custkey) AS r,
              ntile(5) OVER (ORDER BY frequency, o_custkey) AS f, ntile(5) OVER (ORDER BY monetary, o_custkey) AS m FROM f""",
)
def an_rfm(t: Tables):
    return cust.rfm(_features(t), "o_custkey")


@query("an_kmeans")
def an_kmeans(t: Tables):
    return cust.kmeans_segments(_features(t), ["recency", "frequency", "monetary"])


@query("an_bisecting")
def an_bisecting(t: Tables):
    return cust.bisecting_segments(_features(t), ["recency", "frequency", "monetary"])


_RFM_INPUTS = ["recency", "frequency", "monetary"]


def _quality(segmented):
    found = cust.segment_quality(segmented, _RFM_INPUTS)
    explained = (1 - F.sum("inertia") / F.sum("spread")) > 0.5
    return found.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("segments"), explained.alias("explains_half"), F.sum("misplaced").alias("misplaced"))


@query("an_kmeans_quality", "SELECT count(DISTINCT o_custkey) AS rows, 4::BIGINT AS segments, true AS explains_half, 0::BIGINT AS misplaced FROM orders")
def an_kmeans_quality(t: Tables):
    """Every customer is nearest to the mean of the own segment, and the segments explain most of the spread."""
    return _quality(cust.kmeans_segments(_features(t), _RFM_INPUTS, tol=0.0, max_iter=500))


@query("an_bisecting_quality", "SELECT count(DISTINCT o_custkey) AS rows, 4::BIGINT AS segments, true AS explains_half FROM orders")
def an_bisecting_quality(t: Tables):
    """All customers have one of four segments, which explain most of the spread."""
    return _quality(cust.bisecting_segments(_features(t), _RFM_INPUTS)).drop("misplaced")


_COHORT_SQL = """
    WITH a AS (SELECT DISTINCT o_custkey AS u, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS p FROM orders),
         f AS (SELECT u, min(p) AS cohort FROM a GROUP BY 1),
         s AS (SELECT cohort, count(*) AS cohort_size FROM f GROUP BY 1),
         c AS (SELECT cohort, CAST(((year(p) - year(cohort)) * 12 + month(p) - month(cohort)) // 3 AS BIGINT) AS period, count(*) AS users
               FROM a JOIN f USING (u) GROUP BY 1, 2)"""


@query(
    "an_cohort_retention",
    f"{_COHORT_SQL} SELECT cohort, period, users, cohort_size, round(users / cohort_size, 6) AS retention FROM c JOIN s USING (cohort)",
)
def an_cohort_retention(t: Tables):
    return rounded(cust.cohort_retention(t.orders, "o_custkey", "o_orderdate"))


@query(
    "an_cohort_churn",
    f"{_COHORT_SQL} SELECT cohort, period, cohort_size - users AS lost, round(1 - users / cohort_size, 6) AS churn FROM c JOIN s USING (cohort)",
)
def an_cohort_churn(t: Tables):
    return rounded(cust.cohort_churn(t.orders, "o_custkey", "o_orderdate"))


@query(
    "an_funnel",
    """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, ts FROM events),
            v AS (SELECT user_id, day, min(ts) AS t1 FROM e WHERE event_type = 'view' GROUP BY 1, 2),
            c AS (SELECT user_id, day, min(ts) AS t2 FROM e JOIN v USING (user_id, day) WHERE event_type = 'click' AND ts > t1 GROUP BY 1, 2),
            p AS (SELECT user_id, day, min(ts) AS t3 FROM e JOIN c USING (user_id, day) WHERE event_type = 'purchase' AND ts > t2 GROUP BY 1, 2),
            n AS (SELECT CAST(1 AS BIGINT) AS step_no, 'view' AS step, count(*) AS entities FROM v
                  UNION ALL SELECT 2, 'click', count(*) FROM c UNION ALL SELECT 3, 'purchase', count(*) FROM p)
       SELECT step_no, step, entities, round(entities / lag(entities) OVER (ORDER BY step_no), 6) AS step_rate,
              round(entities / first(entities) OVER (ORDER BY step_no), 6) AS total_rate FROM n""",
)
def an_funnel(t: Tables):
    events = t.events.withColumn("day", F.to_date("ts"))
    return rounded(cust.funnel(events, ["user_id", "day"], "event_type", ["view", "click", "purchase"], "ts"))


def _items(t: Tables):
    revenue = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return t.lineitem.groupBy("l_partkey").agg(F.sum(revenue).cast("double").alias("revenue"))


_ABC_SQL = """
    (WITH i AS (SELECT l_partkey, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1),
          s AS (SELECT *, sum(revenue) OVER (ORDER BY revenue DESC, l_partkey ROWS UNBOUNDED PRECEDING) / sum(revenue) OVER () AS cum_share FROM i)
     SELECT *, CASE WHEN cum_share <= 0.80 THEN 'A' WHEN cum_share <= 0.95 THEN 'B' ELSE 'C' END AS class FROM s)"""


@query("an_abc", f"SELECT l_partkey, round(revenue, 4) AS revenue, round(cum_share, 6) AS cum_share, class FROM {_ABC_SQL}")
def an_abc(t: Tables):
    return rounded(rounded(cust.abc_classes(_items(t), "l_partkey", "revenue"), 6, ("cum_share",)), 4, ("revenue",))


@query("an_abc_summary", f"SELECT class, count(*) AS items, round(sum(revenue), 4) AS value FROM {_ABC_SQL} GROUP BY 1")
def an_abc_summary(t: Tables):
    return rounded(cust.abc_summary(_items(t), "l_partkey", "revenue"), 4)


@query(
    "running_total_gaps",
    """SELECT event_id, event_type, round(sum(CASE WHEN event_type = 'purchase' THEN value END) OVER (ORDER BY event_id), 4) AS spent,
              round(sum(CASE WHEN event_type = 'purchase' THEN value END) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS spent_by_user FROM events""",
)
def running_total_gaps(t: Tables):
    """Only purchases have a value; a total is missing until the first of them."""
    rows = t.events.select("event_id", "event_type", "user_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"))
    rows = running_totals(running_totals(rows, [], ["event_id"], {"spent": "paid"}), ["user_id"], ["event_id"], {"spent_by_user": "paid"})
    return rounded(rows.select("event_id", "event_type", "spent", "spent_by_user"), 4)


# ---- regression ------------------------------------------------------------


@query(
    "an_ols_simple",
    """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
              round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1""",
)
def an_ols_simple(t: Tables):
    out = reg.ols_simple(t.lineitem, "l_extendedprice", "l_quantity", ["l_returnflag"])
    return rounded(rounded(out, 6, ("slope", "r2")), 4, ("intercept",))


_INPUTS = ["l_quantity", "l_discount", "l_tax"]


def _det(cells: list[list[str]]) -> str:
    """A 3 x 3 determinant in SQL."""
    (a, b, c), (d, e, f), (g, h, i) = cells
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _ols_sql() -> str:
    """One row: the coefficients b0, b1, b2 by Cramer's rule on covariances, and means, deviations and R²."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    spread = [[f"s{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    replaced = [[[f"c{i}" if j == k else spread[i][j] for j in range(3)] for i in range(3)] for k in range(3)]
    return f"""
        (WITH v AS (SELECT l_extendedprice AS y, {", ".join(f"{c} AS x{i}" for i, c in enumerate(_INPUTS))} FROM lineitem),
              m AS (SELECT {", ".join(f"covar_pop(x{i}, x{j}) AS s{i}{j}" for i, j in pairs)}, {", ".join(f"covar_pop(x{i}, y) AS c{i}, avg(x{i}) AS m{i}, stddev_samp(x{i}) AS d{i}" for i in range(3))},
                           avg(y) AS my, var_pop(y) AS vy, stddev_samp(y) AS dy FROM v),
              b AS (SELECT *, {", ".join(f"{_det(replaced[k])} / {_det(spread)} AS b{k}" for k in range(3))} FROM m)
         SELECT *, my - b0 * m0 - b1 * m1 - b2 * m2 AS intercept, (b0 * c0 + b1 * c1 + b2 * c2) / vy AS r2 FROM b)"""


@query(
    "an_ols_multi",
    f"""WITH f AS (SELECT * FROM {_ols_sql()})
        {" UNION ALL ".join(f"SELECT '{c}' AS term, round(b{i}, 3) AS coefficient FROM f" for i, c in enumerate(_INPUTS))}
        UNION ALL SELECT '(intercept)', round(intercept, 3) FROM f UNION ALL SELECT '(r2)', round(r2, 3) FROM f""",
)
def an_ols_multi(t: Tables):
    return rounded(reg.ols_multi(t.lineitem, "l_extendedprice", _INPUTS), 3)


@query("an_logistic")
def an_logistic(t: Tables):
    return rounded(reg.logistic(t.lineitem, F.col("l_returnflag") == "R", [*_INPUTS, "l_extendedprice"]))


@query(
    "an_logistic_scores",
    " UNION ALL ".join(f"SELECT '{c}' AS term, true AS solved" for c in ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "(intercept)"]),
)
def an_logistic_scores(t: Tables):
    """The equations that the most likely coefficients solve, over the whole table."""
    inputs, label = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], F.col("l_returnflag") == "R"
    scores = reg.score_equations(t.lineitem, label, inputs, reg.logistic(t.lineitem, label, inputs))
    return scores.select("term", (F.abs("score") < 1e-5).alias("solved"))


@query(
    "an_importance_order",
    """WITH c AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature,
                         unnest([abs(corr(y, l_quantity)), abs(corr(y, l_discount)), abs(corr(y, l_tax))]) AS r
                  FROM (SELECT *, l_extendedprice + 5000 * l_quantity AS y FROM lineitem))
       SELECT arg_max(feature, r) AS strongest, true AS weights_add_up, true AS no_negative FROM c""",
)
def an_importance_order(t: Tables):
    """The forest finds the input that a charge by quantity hangs on, and its weights are shares."""
    charged = t.lineitem.withColumn("charge", F.col("l_extendedprice") + 5000 * F.col("l_quantity"))
    found = reg.feature_importance(charged, "charge", _INPUTS)
    weight = F.col("importance")
    return found.agg(F.max_by("feature", weight).alias("strongest"), (F.abs(F.sum(weight) - 1) < 1e-9).alias("weights_add_up"), (F.min(weight) >= 0).alias("no_negative"))


@query("an_feature_importance")
def an_feature_importance(t: Tables):
    return rounded(reg.feature_importance(t.lineitem, "l_extendedprice", _INPUTS))


@query(
    "an_linear_shap",
    """SELECT p_partkey, round((SELECT regr_slope(p_retailprice, p_partkey) FROM part) * (p_partkey - (SELECT avg(p_partkey) FROM part)), 6) AS phi
       FROM part""",
)
def an_linear_shap(t: Tables):
    return rounded(reg.linear_shap(t.part, "p_retailprice", "p_partkey", ["p_partkey"]))


@query(
    "an_linear_shap_multi",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(avg(abs(b{i} * ({c} - m{i}))), 3) AS mean_abs_phi FROM lineitem, {_ols_sql()}""" for i, c in enumerate(_INPUTS)
    ),
)
def an_linear_shap_multi(t: Tables):
    return rounded(reg.linear_shap_multi(t.lineitem, "l_extendedprice", _INPUTS), 3)


@query(
    "an_std_coefficients",
    f"""WITH f AS (SELECT * FROM {_ols_sql()})
        {" UNION ALL ".join(f"SELECT '{c}' AS feature, round(b{i} * d{i} / dy, 6) AS std_coefficient FROM f" for i, c in enumerate(_INPUTS))}""",
)
def an_std_coefficients(t: Tables):
    return rounded(reg.standard_coefficients(t.lineitem, "l_extendedprice", _INPUTS))


# ---- anomalies -------------------------------------------------------------


@query(
    "an_zscore",
    """SELECT event_id, user_id, event_type, value, round((value - m) / s, 6) AS z
       FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE abs((value - m) / s) > 3""",
)
def an_zscore(t: Tables):
    rows = anomaly.zscore_rows(t.events.select("event_id", "user_id", "event_type", "value"), "value")
    return rounded(rows, only=("z",))


_FENCE = "{v} < q1 - 1.5 * (q3 - q1) OR {v} > q3 + 1.5 * (q3 - q1)"


@query(
    "an_iqr",
    f"""SELECT event_id, event_type, value FROM events,
        (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) WHERE {_FENCE.format(v="value")}""",
)
def an_iqr(t: Tables):
    return anomaly.iqr_rows(t.events.select("event_id", "event_type", "value"), "value")


@query(
    "an_iqr_grouped",
    f"""SELECT e.event_type AS event_type, event_id, value, round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper
        FROM events e JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) q
        ON e.event_type = q.event_type WHERE {_FENCE.format(v="value")}""",
)
def an_iqr_grouped(t: Tables):
    rows = anomaly.iqr_rows_by_group(t.events.select("event_id", "event_type", "value"), ["event_type"], "value")
    return rounded(rows, only=("lower", "upper"))



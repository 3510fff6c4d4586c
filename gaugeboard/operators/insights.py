"""Automatic insights: outliers, trends, correlations, and the combined top list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gaugeboard.functions.kinds import number, numeric_cols, quoted, text_literal
from gaugeboard.functions.text import fmt_fixed, percent_change
from gaugeboard.operators.ordered import with_position
from gaugeboard.operators.quantiles import middle_value
from gaugeboard.operators.profile import moments_sql, numeric_moments, pearson_matrix, struct_sql

OUTLIER_Z = 3.0
TREND_PERCENT = 20.0
TREND_MIN_ROWS = 10
CORRELATION = 0.7
KEEP = 5

# The wording and severities of the insights.
OUTLIER_TITLE = "Extreme Value in %s"
OUTLIER_TEXT = "The maximum value (%s) is significantly higher (> 3σ) than the average (%s)."
TREND_TITLE = "%s Trend in %s"
TREND_TEXT = "Values have %s by approximately %s%% from the first half to the second half of the dataset."
CORRELATION_TITLE = "Strong Correlation: %s and %s"
CORRELATION_TEXT = "Values of %s tend to %s as %s rises (r = %s)."
FALLBACK = (
    "general",
    "Consistent Data",
    "No significant outliers or strong trends detected. The data appears stable.",
    "info",
)


def _insight(kind: str, title: Column, text: Column, severity: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("type"), title.alias("title"), text.alias("description"), severity.alias("severity")
    )


def _z_of_max(mean: Column, std: Column, high: Column) -> Column:
    """How many standard deviations the maximum lies above the mean."""
    return F.when(std > 0, F.try_divide(high - mean, std))


def outlier_insights(df: DataFrame, z: float = OUTLIER_Z) -> DataFrame:
    """Numeric columns whose maximum lies more than ``z`` deviations above the mean."""
    return (
        numeric_moments(df)
        .withColumn("z_max", _z_of_max(F.col("mean"), F.col("std"), F.col("max")))
        .where(F.col("z_max") > z)
        .select("ordinal", "column", "mean", "std", "max", "z_max")
    )


def whole_key(df: DataFrame, order_by: Sequence[str]) -> bool:
    """Is the order a single whole-number key, whose middle is found by counting?"""
    return len(order_by) == 1 and isinstance(df.schema[order_by[0]].dataType, (T.IntegerType, T.LongType))


def first_half(df: DataFrame, order_by: Sequence[str], n: int | None = None, known: dict | None = None) -> Column:
    """Does a row come no later than the row of place floor(n / 2) in the order?

    All rows count.  NULL keys come first, and rows tied with the middle row belong to the
    first half; add a tie-breaker to ``order_by`` to split there.  Only the key of the middle row is
    looked for, so the measured columns never move; a whole-number key is found by counting, without a sort.
    ``n`` and ``known`` are as for ``middle_value``.
    """
    if whole_key(df, order_by):
        key, (found, middle) = F.col(quoted(order_by[0])), middle_value(df, order_by[0], n, known)
        if not found:
            return F.lit(False)
        return key.isNull() if middle is None else key.isNull() | (key <= F.lit(middle).cast("bigint"))
    keys = with_position(df.select(*order_by), order_by, "__pos", total="__n")
    row = keys.where(F.col("__pos") == F.floor(F.col("__n") / 2)).select(F.struct(*order_by))
    return F.coalesce(F.struct(*order_by) <= row.scalar(), F.lit(False))


def _half_means(df: DataFrame, order_by: Sequence[str], cols: Sequence[str]) -> list[Column]:
    """Per column a struct of the means of the two halves, and the row count."""
    in_first = first_half(df, order_by)

    def half(name: str, rows: Column) -> Column:
        return F.avg(F.when(rows, number(df, name)))

    return [
        F.struct(half(c, in_first).alias("first"), half(c, ~in_first).alias("second")).alias(f"h{i}")
        for i, c in enumerate(cols)
    ]


def trend_insights(
    df: DataFrame, order_by: Sequence[str], min_rows: int = TREND_MIN_ROWS, percent: float = TREND_PERCENT
) -> DataFrame:
    """Numeric columns whose second-half mean differs from the first by over ``percent``.

    The change is relative to the signed first mean; a zero mean gives no trend.
    """
    cols = numeric_cols(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "ordinal bigint, `column` string, first_mean double, second_mean double, pct_change double, direction string"
        )
    agg = df.agg(F.count(F.lit(1)).alias("n"), *_half_means(df, order_by, cols)).where(F.col("n") > min_rows)
    rows = agg.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).cast("bigint").alias("ordinal"),
                        F.lit(c).alias("column"),
                        F.col(f"h{i}.first").alias("first_mean"),
                        F.col(f"h{i}.second").alias("second_mean"),
                        percent_change(F.col(f"h{i}.first"), F.col(f"h{i}.second")).alias("pct_change"),
                    )
                    for i, c in enumerate(cols)
                ]
            )
        )
    )
    return rows.where(F.abs("pct_change") > percent).withColumn(
        "direction", F.when(F.col("pct_change") > 0, F.lit("Upward")).otherwise(F.lit("Downward"))
    )


def correlation_insights(df: DataFrame, threshold: float = CORRELATION) -> DataFrame:
    """Pairs of different numeric columns with a strong correlation."""
    pairs = pearson_matrix(df)
    return pairs.where((F.col("col_a") < F.col("col_b")) & (F.abs("corr") >= threshold))


def correlation_records(df: DataFrame, threshold: float = CORRELATION) -> DataFrame:
    """The same pairs as insight rows: type, title, description, severity."""
    words = F.when(F.col("corr") > 0, "rise").otherwise("fall")
    text = F.format_string(CORRELATION_TEXT, "col_b", words, "col_a", fmt_fixed(F.col("corr"), 2))
    found = _insight("correlation", F.format_string(CORRELATION_TITLE, "col_a", "col_b"), text, F.lit("info"))
    return correlation_insights(df, threshold).select(found.alias("i")).select("i.*")


def insight_array(
    df: DataFrame, aggregated: DataFrame, keep: int = KEEP, with_columns: Sequence[Column] = ()
) -> DataFrame:
    """The top insights of a table from its one-row ``insight_aggregates`` result.

    ``with_columns`` adds more columns computed from the same row.
    """
    cols = numeric_cols(df)
    facts = ", ".join(f"named_struct('name', {text_literal(c)}, 'm', m{i}, 'h', h{i})" for i, c in enumerate(cols))

    def outlier(fact: Column) -> Column:
        m = fact.getField("m")
        mean, high = m.getField("mean"), m.getField("max")
        text = F.format_string(OUTLIER_TEXT, fmt_fixed(high, 2), fmt_fixed(mean, 2))
        found = _insight("outlier", F.format_string(OUTLIER_TITLE, fact.getField("name")), text, F.lit("warning"))
        return F.when(_z_of_max(mean, m.getField("std"), high) > OUTLIER_Z, found)

    def trend(fact: Column) -> Column:
        h = fact.getField("h")
        change = percent_change(h.getField("first"), h.getField("second"))
        up = change > 0
        title = F.format_string(TREND_TITLE, F.when(up, "Upward").otherwise("Downward"), fact.getField("name"))
        text = F.format_string(TREND_TEXT, F.when(up, "increased").otherwise("decreased"), fmt_fixed(F.abs(change), 1))
        found = _insight("trend", title, text, F.when(up, "positive").otherwise("info"))
        return F.when((F.col("n") > TREND_MIN_ROWS) & (F.abs(change) > TREND_PERCENT), found)

    kind, title, text, severity = FALLBACK
    fallback = F.array(_insight(kind, F.lit(title), F.lit(text), F.lit(severity)))
    if cols:
        listed = F.expr(f"array({facts})")
        found = F.array_compact(F.concat(F.transform(listed, outlier), F.transform(listed, trend)))
    else:
        found = F.slice(fallback, 1, 0)
    chosen = F.when(F.size(found) == 0, fallback).otherwise(found)
    return aggregated.select(F.slice(chosen, 1, keep).alias("insights"), *with_columns)


def insight_aggregates(df: DataFrame, order_by: Sequence[str]) -> list[Column]:
    """Aggregates that ``insight_array`` needs: count, moments and half means."""
    cols = numeric_cols(df)
    means = _half_means(df, order_by, cols) if cols else []
    return [
        F.count(F.lit(1)).alias("n"),
        *[F.expr(struct_sql(**moments_sql(df, c))).alias(f"m{i}") for i, c in enumerate(cols)],
        *means,
    ]


def insights(df: DataFrame, order_by: Sequence[str], keep: int = KEEP) -> DataFrame:
    """Outliers then trends in column order, the first ``keep``; one scan of the table."""
    found = insight_array(df, df.agg(*insight_aggregates(df, order_by)), keep)
    return found.select(F.posexplode("insights").alias("ordinal", "i")).select(
        F.col("ordinal").cast("bigint").alias("ordinal"), "i.type", "i.title", "i.description", "i.severity"
    )


def fallback_insight(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The fallback row if the table gives no other insight, else no row."""
    return insights(df, order_by).where(F.col("type") == FALLBACK[0])

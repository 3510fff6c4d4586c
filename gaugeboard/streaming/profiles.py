"""Profiles that add up: the state of a batch of rows, states folded into one, and what they tell.

A state has one row per pair of number columns (moments around the pair's own means; for a column with itself
also a quantile sketch) and one per text column (extremes and a frequent-items sketch).  States of
any rows fold into the state of all of them, so files are read once, when they arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeboard.functions.kinds import categorical_cols, number_sql, numeric_cols, quoted, text_literal
from gaugeboard.operators.comoments import MOMENTS, correlation, merge_moments, pair_moments

#: Size of the quantile sketches; the share of values by which a median may be off (the sketch promises less).
SKETCH_SIZE = 8192
MEDIAN_BOUND = 0.001
#: Different texts that are tracked; counts are exact up to three quarters of it, else off by rows / it at most.
TRACKED = 4096
NUMBER, TEXT = "number", "text"
_KEYS = ["kind", "column", "other"]
SCHEMA = (
    "kind string, `column` string, other string, n long, "
    + ", ".join(f"{m} double" for m in MOMENTS)
    + ", low_text string, high_text string, sketch binary, "
    + "top struct<sketch: binary, maxItemsTracked: int, itemDataType: string, itemDataTypeDDL: string>"
)


def _shaped(df: DataFrame) -> DataFrame:
    """The columns of ``SCHEMA``; those that are absent are NULL."""
    fields = df.sparkSession.createDataFrame([], SCHEMA).schema.fields
    return df.select(*[(F.col(quoted(f.name)) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def state(rows: DataFrame) -> DataFrame:
    """The state of some rows: one scan for the moments, one for the sketches."""
    numbers, texts = numeric_cols(rows), categorical_cols(rows)
    structs, parts = [], []
    for c in numbers:
        sketch = f"kll_sketch_agg_double({number_sql(rows, c)}, {SKETCH_SIZE})"
        structs.append(f"named_struct('kind', '{NUMBER}', 'column', {text_literal(c)}, 'other', {text_literal(c)}, 'n', 0L, 'low_text', NULL, 'high_text', NULL, 'sketch', {sketch}, 'top', NULL)")
    for c in texts:
        v = f"CAST({quoted(c)} AS STRING)"
        top = f"approx_top_k_accumulate({v}, {TRACKED}) FILTER (WHERE {v} IS NOT NULL)"
        structs.append(f"named_struct('kind', '{TEXT}', 'column', {text_literal(c)}, 'other', NULL, 'n', count({v}), 'low_text', min({v}), 'high_text', max({v}), 'sketch', NULL, 'top', {top})")
    if structs:
        agg = rows.agg(*[F.expr(s).alias(f"s{i}") for i, s in enumerate(structs)])
        for i in range(len(structs)):
            parts.append(_shaped(agg.select(f"s{i}.*")))
    if numbers:
        names = F.array(*[F.lit(c) for c in numbers])
        moments = pair_moments(rows, numbers).withColumns({"column": F.get(names, F.col("i")), "other": F.get(names, F.col("j")), "kind": F.lit(NUMBER)})
        parts.append(_shaped(moments))
    out = rows.sparkSession.createDataFrame([], SCHEMA)
    for part in parts:
        out = out.unionByName(part)
    return fold(out)


def fold(states: DataFrame) -> DataFrame:
    """One state from several; the rows of a key are as few as the states."""
    numbers, texts = states.where(F.col("kind") == NUMBER), states.where(F.col("kind") == TEXT)
    # A sketch comes without moments; moments over no rows change nothing.
    filled = numbers.withColumns({m: F.coalesce(m, F.lit(0.0)) for m in ("mean_x", "mean_y", "xx", "yy", "xy")})
    moments = merge_moments(filled, _KEYS)
    sketches = numbers.where("sketch IS NOT NULL").groupBy(*_KEYS).agg(F.expr("kll_merge_agg_double(sketch)").alias("sketch"))
    merged = texts.groupBy("kind", "column").agg(
        F.sum("n").alias("n"), F.min("low_text").alias("low_text"), F.max("high_text").alias("high_text"), F.expr(f"approx_top_k_combine(top, {TRACKED})").alias("top")
    )
    return _shaped(moments.join(sketches, _KEYS, "left")).unionByName(_shaped(merged))


class Profile:
    """What a folded state tells."""

    def __init__(self, states: DataFrame):
        self.state = fold(states)

    def summary(self) -> DataFrame:
        """Per column: n, mean, std, min, max and median (within ``MEDIAN_BOUND``); text columns min_text and max_text only."""
        own = (F.col("kind") == TEXT) | (F.col("column") == F.col("other"))
        some = F.col("n") > 0

        def number(value: Column) -> Column:
            return F.when((F.col("kind") == NUMBER) & some, value).cast("double")

        std = F.when(F.col("n") > 1, F.sqrt(F.col("xx") / (F.col("n") - 1)))
        median = F.expr("CASE WHEN kind = 'number' AND n > 0 THEN kll_sketch_get_quantile_double(sketch, 0.5D) END")
        return self.state.where(own).select(
            "column", "n", number(F.col("mean_x")).alias("mean"), number(std).alias("std"), number(F.col("low_x")).alias("min"), number(F.col("high_x")).alias("max"),
            median.alias("median"), F.col("low_text").alias("min_text"), F.col("high_text").alias("max_text"),
        )

    def categories(self, k: int = 10) -> DataFrame:
        """The most frequent texts per text column: column, category, count; of equal counts the least texts."""
        listed = F.expr(f"inline(approx_top_k_estimate(top, {TRACKED}))")
        items = self.state.where((F.col("kind") == TEXT) & (F.col("n") > 0)).select("column", listed)
        best = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("least"), F.col("item").alias("category"))))
        held = items.groupBy("column").agg(F.slice(best, 1, k).alias("best"))  # TRACKED items at most
        return held.select("column", F.explode("best").alias("b")).select("column", "b.category", (-F.col("b.least")).alias("count"))

    def correlations(self) -> DataFrame:
        """Pearson's correlation of every ordered pair of number columns: col_a, col_b, corr."""
        pairs = self.state.where(F.col("kind") == NUMBER).select("column", "other", correlation().alias("corr"))
        one, two = F.struct(F.col("column").alias("col_a"), F.col("other").alias("col_b")), F.struct(F.col("other").alias("col_a"), F.col("column").alias("col_b"))
        both = F.when(F.col("column") == F.col("other"), F.array(one)).otherwise(F.array(one, two))
        return pairs.select(F.explode(both).alias("at"), "corr").select("at.*", "corr")

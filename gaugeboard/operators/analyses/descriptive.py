"""Descriptive statistics, modes, distributions and rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gaugeboard.functions.kinds import number, number_sql, numeric_cols, quoted, text_literal
from gaugeboard.operators.ordered import running_totals
from gaugeboard.operators.profile import pearson_matrix
from gaugeboard.operators.quantiles import exact_quantiles
from gaugeboard.session import materialize

QUARTILES = (0.25, 0.5, 0.75)
DECILES = tuple(i / 10 for i in range(11))
# Different values, of all columns together, whose ranks are sent to every task.
LOOKED_UP = 200_000


def descriptive(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles and max per numeric column."""
    cols = numeric_cols(df) if cols is None else list(cols)
    quartiles = exact_quantiles(df, cols, QUARTILES)
    agg = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(number(df, c)).alias("n"),
                F.avg(number(df, c)).alias("mean"),
                F.stddev_samp(number(df, c)).alias("std"),
                F.min(number(df, c)).alias("min"),
                *[F.lit(q).cast("double").alias(name) for q, name in zip(quartiles[c], ("q1", "median", "q3"))],
                F.max(number(df, c)).alias("max"),
            ).alias(f"d{i}")
            for i, c in enumerate(cols)
        ]
    )
    return agg.select(F.inline(F.array(*[F.col(f"d{i}") for i in range(len(cols))])))


def modes(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value per column, the smallest of equally frequent ones."""
    cols = numeric_cols(df) if cols is None else list(cols)
    best = _value_counts(df, cols).groupBy("c").agg(F.max(F.struct("n", (-F.col("value")).alias("neg"))).alias("b"))
    return best.select(_name(cols), (-F.col("b.neg")).alias("mode"), F.col("b.n").alias("n"))


def quantile_table(df: DataFrame, col: str, probs: Sequence[float] = DECILES) -> DataFrame:
    """Quantiles of one column as rows (prob, value)."""
    values = exact_quantiles(df, [col], probs)[col]
    entries = [F.struct(F.lit(p).alias("prob"), F.lit(v).cast("double").alias("value")) for p, v in zip(probs, values)]
    return df.agg(F.count(number(df, col)).alias("n")).where(F.col("n") > 0).select(F.inline(F.array(*entries)))


def average_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, rank) of each distinct value; equal values share their mean rank.

    All columns are ranked in one pass: values are counted, and running counts over
    the range-partitioned counts give the ranks.
    """
    return _coded_ranks(df, cols).select(_name(cols), "value", "rank")


def _coded_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(c, value, rank): as ``average_ranks``, by the column's place."""
    counted = materialize(_value_counts(df, cols), "counts")
    ranked = running_totals(counted, ["c"], ["value"], {"upto": "n"})
    return ranked.select("c", "value", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def _name(cols: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in cols]), F.col("c")).alias("column")


def _value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per (place of the column, value), missing values left out."""
    pairs = ", ".join(f"named_struct('c', {i}, 'value', {number_sql(df, c)})" for i, c in enumerate(cols))
    long = df.selectExpr(f"inline(array({pairs}))").where(F.col("value").isNotNull())
    return long.groupBy("c", "value").agg(F.count(F.lit(1)).alias("n"))


def _ranked(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The ranks of all columns of rows without missing values, as columns of the same names.

    Columns with few different values are looked up in lists of a checked size.  Those of all other columns are
    joined at once, as (row, column, value), and given back by row: two shuffles, however many columns there are.
    """
    ranks = materialize(_coded_ranks(df, cols), "ranks")
    sizes = {r["c"]: r["n"] for r in ranks.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    few, room = [], LOOKED_UP
    for i in sorted(range(len(cols)), key=lambda i: sizes.get(i, 0)):
        room -= sizes.get(i, 0)
        if room >= 0:
            few.append(i)
    many = [i for i in range(len(cols)) if i not in few]
    out = df.select(F.monotonically_increasing_id().alias("row"), *[number(df, c).alias(f"v{i}") for i, c in enumerate(cols)])
    for i in few:
        own = ranks.where(F.col("c") == i).select(F.col("value").alias(f"v{i}"), F.col("rank").alias(f"r{i}"))
        out = out.join(F.broadcast(own), f"v{i}")  # LOOKED_UP rows at most, all columns together
    if many:
        known = [f"r{i}" for i in few]  # they ride with the first of the row's entries
        entries = [F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("value"), *[F.when(F.lit(i == many[0]), F.col(k)).alias(k) for k in known]) for i in many]
        back = [F.max(F.when(F.col("c") == i, F.col("rank"))).alias(f"r{i}") for i in many]
        long = out.select("row", F.inline(F.array(*entries))).join(ranks.where(F.col("c").isin(many)), ["c", "value"])
        if len(many) == 1:  # a row is one entry
            out = long.select(F.col("rank").alias(f"r{many[0]}"), *known)
        else:
            out = long.groupBy("row").agg(*back, *[F.max(k).alias(k) for k in known])
    return out.select(*[F.col(f"r{i}").alias(c) for i, c in enumerate(cols)])


def _rank_correlations(df: DataFrame, cols: Sequence[str], n: int) -> DataFrame:
    """Pearson matrix of the ranks of columns without missing values in ``n`` rows."""
    # Every rank column has mean (n + 1) / 2, so no pass is needed to find it.
    fact = {"complete": True, "mean": (n + 1) / 2, "low": 1.0, "high": float(n)}
    return pearson_matrix(_ranked(df, cols), cols, {c: fact for c in cols})


def spearman_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rank correlation of every pair of different columns, over rows complete in both.

    Columns that are present in the same rows form a class.  The columns of two classes are ranked together
    over the rows that have both, so the passes grow with the classes, not with the pairs of columns.
    """
    cols = numeric_cols(df) if cols is None else list(cols)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    here = {c: f"({number_sql(df, c)}) IS NOT NULL" for c in cols}
    sizes = df.agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"count_if({here[c]})").alias(f"n{i}") for i, c in enumerate(cols)]).first()
    n = {c: sizes[f"n{i}"] for i, c in enumerate(cols)}
    gaps = [c for c in cols if n[c] < sizes["n"]]
    gap_pairs = [(a, b) for i, a in enumerate(gaps) for b in gaps[i + 1 :]]
    both = {}
    if gap_pairs:
        both = dict(zip(gap_pairs, df.agg(*[F.expr(f"count_if({here[a]} AND {here[b]})").alias(f"b{i}") for i, (a, b) in enumerate(gap_pairs)]).first()))

    def together(a: str, b: str) -> int:
        """Rows that have both; ``a`` comes no later than ``b``, and a complete column takes nothing away."""
        return both.get((a, b), min(n[a], n[b]))

    classes: list[list[str]] = []
    for c in cols:
        same = next((one for one in classes if n[c] == n[one[0]] == together(one[0], c)), None)
        if same is None:
            classes.append([c])
        else:
            same.append(c)
    parts = []
    for i, one in enumerate(classes):
        for other in classes[i:]:
            pairs = [(a, b) for j, a in enumerate(cols) for b in cols[j + 1 :] if (a in one and b in other) or (a in other and b in one)]
            if not pairs:
                continue
            used = [c for c in cols if c in one or c in other]
            rows = df.where(f"{here[one[0]]} AND {here[other[0]]}").select(*[F.col(quoted(c)) for c in used])
            wanted = ", ".join(f"{text_literal(a)} || '\t' || {text_literal(b)}" for a, b in pairs)
            parts.append(_rank_correlations(rows, used, together(one[0], other[0])).where(F.expr(f"col_a || '\t' || col_b IN ({wanted})")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

"""Profiles of one table: shape, summaries, categories, histograms, correlations.

Each operator reads only the columns it names and scans the table once, unless
its docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gaugeboard.functions.kinds import (
    CATEGORICAL,
    NUMERIC,
    TEMPORAL,
    default_xy,
    default_xyz,
    double_literal,
    kind,
    number,
    number_sql,
    numeric_cols,
    present,
    quoted,
    text_literal,
)
from gaugeboard.operators.comoments import correlation, merge_moments, pair_moments
from gaugeboard.operators.quantiles import exact_quantiles
from gaugeboard.session import materialize

PREVIEW_ROWS = 1000
TOP_CATEGORIES = 10
PIE_SLICES = 5
BINS = 20
LINE_BINS = 1000
# Tables with more columns than this are bounded by key before they are sorted.
WIDE = 4
# Up to so many pairs of columns are correlated by aggregate functions, more by matrix products; with the same values.
PAIRS_PER_PASS = 60


def _col(name: str) -> Column:
    return F.col(quoted(name))


def struct_sql(**fields: str) -> str:
    """SQL text of a struct with the given fields."""
    return "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in fields.items()) + ")"


def _rows(df: DataFrame, structs: Sequence[str]) -> DataFrame:
    """Aggregate ``df`` once and return one row per struct."""
    agg = df.agg(*[F.expr(sql).alias(f"c{i}") for i, sql in enumerate(structs)])
    return agg.selectExpr("inline(array(" + ", ".join(f"c{i}" for i in range(len(structs))) + "))")


def _long(agg: DataFrame, structs: Sequence[str]) -> DataFrame:
    """Turn the struct columns of a one-row result into rows."""
    return agg.select(F.inline(F.array(*[F.col(s) for s in structs])))


def dataset_shape(df: DataFrame) -> DataFrame:
    """Row and column counts."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).cast("bigint").alias("column_count"))


def schema_listing(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, kind and how many values it holds."""
    return _rows(
        df,
        [
            struct_sql(
                ordinal=f"{i}L",
                column=text_literal(f.name),
                type=text_literal(f.dataType.simpleString()),
                kind=text_literal(kind(f.dataType)),
                n_values=f"count({quoted(f.name)})",
            )
            for i, f in enumerate(df.schema.fields)
        ],
    )


def top_categories(df: DataFrame, col: str, n: int = TOP_CATEGORIES) -> DataFrame:
    """The ``n`` most frequent values; a missing category is listed with count 0."""
    return most_frequent(df.groupBy(_col(col).alias("category")).agg(F.count(_col(col)).alias("count")), n)


def most_frequent(counts: DataFrame, n: int = TOP_CATEGORIES) -> DataFrame:
    """The ``n`` largest of (category, count)."""
    return counts.select("category", "count").orderBy(F.col("count").desc(), F.col("category").asc()).limit(n)


def column_summary(df: DataFrame, col: str) -> DataFrame:
    """Sum, mean, min, max and count of the numbers in a column."""
    value = number(df, col)
    return df.agg(
        F.sum(value).alias("sum"),
        F.avg(value).alias("avg"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(value).alias("count"),
    )


def moments_sql(df: DataFrame, name: str) -> dict[str, str]:
    value = number_sql(df, name)
    return {
        "mean": f"avg({value})",
        "std": f"coalesce(stddev_samp({value}), 0D)",
        "max": f"max({value})",
        "min": f"min({value})",
    }


def numeric_moments(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean, standard deviation, max and min of every numeric column."""
    cols = numeric_cols(df) if cols is None else list(cols)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "ordinal bigint, `column` string, mean double, std double, max double, min double"
        )
    return _rows(
        df, [struct_sql(ordinal=f"{i}L", column=text_literal(c), **moments_sql(df, c)) for i, c in enumerate(cols)]
    )


def describe(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: values, mean, std, min, max, median; text columns get min and max only.

    ``exact=False`` takes the median from a sketch in the same pass.
    """
    medians = exact_quantiles(df, numeric_cols(df), [0.5]) if exact else {}
    structs = []
    for i, f in enumerate(df.schema.fields):
        what, name = kind(f.dataType), quoted(f.name)
        value = number_sql(df, f.name) if what == NUMERIC else None
        median = double_literal(medians[f.name][0]) if f.name in medians else f"percentile_approx({value}, 0.5D)"
        text = name if what in (CATEGORICAL, TEMPORAL) else None
        structs.append(
            struct_sql(
                ordinal=f"{i}L",
                column=text_literal(f.name),
                n_values=f"count({value or name})",
                **{
                    out: f"CAST({sql} AS DOUBLE)" if value else "CAST(NULL AS DOUBLE)"
                    for out, sql in {
                        "mean": f"avg({value})",
                        "std": f"stddev_samp({value})",
                        "min": f"min({value})",
                        "max": f"max({value})",
                        "median": median,
                    }.items()
                },
                **{f"{end}_text": f"CAST({end}({text}) AS STRING)" if text else "CAST(NULL AS STRING)" for end in ("min", "max")},
            )
        )
    return _rows(df, structs)


def _pair_sums(df: DataFrame, names: tuple[str, str], facts: dict) -> dict[str, str]:
    """SQL sums over all rows of two columns without gaps, shifted by their means.

    Shifted plain sums are accurate, as the mean of a column is that of the pair's rows, and are the
    cheapest aggregates; equal ones of different pairs are computed once.
    """
    x, y = (f"({number_sql(df, c)} - {double_literal(facts[c]['mean'])})" for c in names)
    return {"n": f"count({x})", "x": f"sum({x})", "y": f"sum({y})", "xx": f"sum({x} * {x})", "yy": f"sum({y} * {y})", "xy": f"sum({x} * {y})"}


def _pair_corr(at: dict[str, str]) -> str:
    """SQL correlation from the columns that hold ``_pair_sums``."""
    cov = f"({at['xy']} - try_divide({at['x']} * {at['y']}, {at['n']}))"
    var_x = f"({at['xx']} - try_divide({at['x']} * {at['x']}, {at['n']}))"
    var_y = f"({at['yy']} - try_divide({at['y']} * {at['y']}, {at['n']}))"
    return f"try_divide({cov}, sqrt({var_x}) * sqrt({var_y}))"


def _column_facts(df: DataFrame, cols: Sequence[str]) -> dict[str, dict]:
    """Per column: mean, range, and whether no value is missing.  One scan."""
    found = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.expr(struct_sql(n=f"count({v})", mean=f"avg({v})", low=f"min({v})", high=f"max({v})")).alias(f"f{i}")
            for i, v in enumerate(number_sql(df, c) for c in cols)
        ],
    ).first()
    facts = {c: found[f"f{i}"].asDict() for i, c in enumerate(cols)}
    for fact in facts.values():
        fact["complete"] = fact["n"] == found["rows"]
    return facts


def pearson_matrix(df: DataFrame, cols: Sequence[str] | None = None, facts: dict[str, dict] | None = None) -> DataFrame:
    """Correlation of every ordered pair of numeric columns, diagonal included.

    Rows where either column is missing are left out of that pair; a pair in which a side has only one value
    has no correlation.  One scan finds the means (unless ``facts`` gives them), a second adds up the products
    of all pairs.  Pairs with gaps are centred by their own rows.
    """
    cols = numeric_cols(df) if cols is None else list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    if len(pairs) > PAIRS_PER_PASS:
        return _wide_pearson(df, cols)
    facts = facts or _column_facts(df, cols)
    sums: dict[str, str] = {}  # SQL text -> name, so that shared sums occur once
    entries = []
    for a, b in pairs:
        if any(facts[c]["low"] == facts[c]["high"] for c in (a, b)):
            corr = "CAST(NULL AS DOUBLE)"
        elif all(facts[c]["complete"] for c in (a, b)):
            corr = _pair_corr({k: sums.setdefault(sql, f"s{len(sums)}") for k, sql in _pair_sums(df, (a, b), facts).items()})
        else:
            corr = sums.setdefault(f"corr({number_sql(df, a)}, {number_sql(df, b)})", f"s{len(sums)}")
        for x, y in dict.fromkeys([(a, b), (b, a)]):
            entries.append(struct_sql(col_a=text_literal(x), col_b=text_literal(y), corr=corr))
    totals = df.agg(F.count(F.lit(1)).alias("rows"), *[F.expr(sql).alias(name) for sql, name in sums.items()])
    return totals.selectExpr(f"inline(array({', '.join(entries)}))")


def _wide_pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All pairs from one scan; a task sends one row per pair."""
    found = merge_moments(pair_moments(df, cols), ["i", "j"]).select("i", "j", correlation().alias("corr"))
    one, other = F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    found = found.select(F.explode(F.when(F.col("i") < F.col("j"), F.array(one, other)).otherwise(F.array(one))).alias("at"), "corr").select("at.*", "corr")
    names = ", ".join(text_literal(c) for c in cols)
    every = df.sparkSession.range(len(cols)).selectExpr("id AS i", f"explode(sequence(0L, {len(cols) - 1}L)) AS j")
    return every.join(found, ["i", "j"], "left").selectExpr(f"array({names})[i] AS col_a", f"array({names})[j] AS col_b", "corr")


def corr_map(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """The correlation matrix as one nested map, as the profile manifest stores it."""
    matrix = pearson_matrix(df, cols)
    rows = matrix.groupBy("col_a").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("col_b", "corr")))).alias("row")
    )
    return rows.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("col_a", F.map_entries("row").alias("row"))))).alias("m")
    ).select(F.transform_values("m", lambda _, entries: F.map_from_entries(entries)).alias("correlations"))


def _bounds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with a {lo, hi} struct per column."""
    return df.agg(
        *[F.struct(F.min(number(df, c)).alias("lo"), F.max(number(df, c)).alias("hi")).alias(f"b{i}") for i, c in enumerate(cols)]
    )


def bin_of(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin; the right edge belongs to the last bin, a constant to the first."""
    return (
        F.when(value.isNull(), None)
        .when(lo == hi, F.lit(0))
        .otherwise(F.least(F.width_bucket(value, lo, hi, F.lit(bins)) - 1, F.lit(bins - 1)))
        .cast("bigint")
    )


def histogram(df: DataFrame, col: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins over the whole column, empty bins included.

    Two scans of one column: the range, then the counts.
    """
    value = number(df, col)
    bounds = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    counts = (
        df.select(bin_of(value, lo, hi, bins).alias("bin"))
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return histogram_of(counts, lo, hi, bins)


def histogram_of(counts: DataFrame, lo: Column, hi: Column, bins: int = BINS) -> DataFrame:
    """The histogram with counts (bin, count) of a column that ranges from ``lo`` to ``hi``."""
    spark = counts.sparkSession
    n_bins = F.when(lo.isNull(), 0).when(lo == hi, 1).otherwise(bins)
    width = (hi - lo) / bins
    return (
        spark.range(bins)
        .select(F.col("id").alias("bin"))
        .where(F.col("bin") < n_bins)
        .join(counts, "bin", "left")
        .select(
            "bin",
            (lo + F.col("bin") * width).alias("lo"),
            F.when(lo == hi, hi).otherwise(lo + (F.col("bin") + 1) * width).alias("hi"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
    )


def pie_share(df: DataFrame, category: str, value: str, n: int = PIE_SLICES) -> DataFrame:
    """Sum and share per category, the largest ``n`` kept and the rest added up.

    The sums per category are stored, so the table is read once.
    """
    sums = df.groupBy(_col(category).cast("string").alias("category")).agg(F.sum(number(df, value)).alias("total"))
    return shares_of(materialize(sums, "pie"), n)


def shares_of(sums: DataFrame, n: int = PIE_SLICES) -> DataFrame:
    """The shares of stored sums (category, total)."""
    largest = [F.col("total").desc_nulls_last(), F.col("category").asc()]
    top = sums.select("category", "total").orderBy(*largest).limit(n)
    whole = sums.agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"))
    shown = F.coalesce(top.agg(F.sum("total")).scalar(), F.lit(0.0))
    rest = whole.where(F.col("n") > n).select(
        F.lit("other").alias("category"), (F.col("total") - shown).alias("total"), F.lit(1).alias("__rest")
    )
    everything = whole.select("total").scalar()
    return (
        top.select("category", "total", F.lit(0).alias("__rest"))
        .unionByName(rest)
        .orderBy("__rest", *largest)
        .select("category", "total", F.try_divide(F.col("total"), everything).alias("share"))
    )


def first_rows(df: DataFrame, order_by: Sequence[str], n: int, descending: bool = False) -> DataFrame:
    """The first ``n`` rows in an order (NULL keys first, or last if descending).

    Of a wide table only the leading key is read in full: its n-th value bounds the
    rows, and that bound is pushed down to the scan of the other columns.
    """
    order = [_col(k).desc() if descending else _col(k).asc() for k in order_by]
    if len(df.columns) > WIDE:
        key = _col(order_by[0])
        leading = df.select(key.alias("k")).orderBy(F.col("k").desc() if descending else F.col("k").asc()).limit(n)
        if descending:
            full = F.count("k") == n
            bound = leading.agg(F.when(full, F.min("k"))).scalar()
            df = df.where((key >= bound) | bound.isNull())
        else:
            df = df.where(key.isNull() | (key <= leading.agg(F.max("k")).scalar()))
    return df.orderBy(*order).limit(n)


def preview(df: DataFrame, order_by: Sequence[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return first_rows(df, order_by, n)


def pie_first(df: DataFrame, order_by: Sequence[str], y: str | None = None, n: int = PIE_SLICES) -> DataFrame:
    """The y values of the first rows, not aggregated, in row order."""
    y = y or default_xy(df)[1]
    return preview(df.select(*order_by, _col(y).alias("y")), order_by, n)


def chart_points(df: DataFrame, order_by: Sequence[str], x: str | None = None, y: str | None = None, n: int = PREVIEW_ROWS) -> DataFrame:
    """Raw (x, y) rows of the preview for a bar or line chart."""
    auto_x, auto_y = default_xy(df)
    kept = df.select(*order_by, _col(x or auto_x).alias("x"), _col(y or auto_y).alias("y"))
    return preview(kept, order_by, n)


def line_points(df: DataFrame, x: str, y: str, bins: int = LINE_BINS) -> DataFrame:
    """(bin, x, y): the points that draw the line of a whole table as all of its points would.

    The x axis is cut into equal ``bins``, as many as the chart is pixels wide; of each the first, the last, the
    least and the largest point stay, four at most.  Times count in seconds.  Of points with equal x the one with
    the least y is the first and the one with the largest y the last.  Two scans: the range, then the points.
    """
    across = F.unix_micros(_col(x).cast("timestamp")) / 1e6 if kind(df.schema[x].dataType) == TEMPORAL else number(df, x)
    points = df.select(across.alias("x"), number(df, y).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    bounds = points.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("b")).select("b").scalar()
    binned = points.select(bin_of(F.col("x"), bounds.getField("lo"), bounds.getField("hi"), bins).alias("bin"), "x", "y")
    ends = [f(F.struct(a, b)) for f in (F.min, F.max) for a, b in (("x", "y"), ("y", "x"))]
    kept = binned.groupBy("bin").agg(*[e.alias(f"e{i}") for i, e in enumerate(ends)])
    listed = F.array_distinct(F.array(*[F.struct(F.col(f"e{i}.x").alias("x"), F.col(f"e{i}.y").alias("y")) for i in range(4)]))
    return kept.select("bin", F.inline(listed))


def chart_bar_agg(df: DataFrame, x: str, y: str) -> DataFrame:
    """Sum of y per x over the whole table."""
    return df.groupBy(_col(x).alias("x")).agg(F.sum(number(df, y)).alias("y"))


def scatter_points(
    df: DataFrame, key: Sequence[str] = (), x: str | None = None, y: str | None = None, z: str | None = None
) -> DataFrame:
    """Every row as (x, y, z, color).  ``z='none'`` gives a flat plot coloured by y."""
    auto_x, auto_y, auto_z = default_xyz(df)
    x, y, z = x or auto_x, y or auto_y, z or auto_z
    flat = z == "none"
    return df.select(
        *key,
        present(df, x).alias("x"),
        present(df, y).alias("y"),
        (F.lit(None).cast("double") if flat else present(df, z)).alias("z"),
        present(df, y if flat else z).alias("color"),
    )


def scatter_grid(df: DataFrame, x: str, y: str, bins: int = BINS) -> DataFrame:
    """A scatter plot of any size as counts on a bins x bins grid."""
    bounds = _bounds(df, [x, y]).select(F.struct("b0", "b1")).scalar()
    bx, by = bounds.getField("b0"), bounds.getField("b1")
    return (
        df.select(
            bin_of(number(df, x), bx.getField("lo"), bx.getField("hi"), bins).alias("x_bin"),
            bin_of(number(df, y), by.getField("lo"), by.getField("hi"), bins).alias("y_bin"),
        )
        .where(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
        .groupBy("x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def kpis(df: DataFrame, style: str = "simple") -> DataFrame:
    """KPI rows (ordinal, label, value) of a dashboard style."""
    rows = F.count(F.lit(1))
    cols = len(df.columns)
    if style == "ml":
        entries = [("Dataset Size", rows.cast("string")), ("Features", F.lit(str(cols)))]
    elif style == "view":
        entries = [
            ("Total Rows", rows.cast("string")),
            ("Columns", F.lit(str(cols))),
            ("Dataset Name", F.lit("Analysis Report")),
        ]
    else:
        entries = [("Total Rows", F.format_number(rows, 0)), ("Total Columns", F.lit(f"{cols:,}"))]
    agg = df.agg(
        *[
            F.struct(F.lit(i).cast("bigint").alias("ordinal"), F.lit(label).alias("label"), v.alias("value")).alias(f"k{i}")
            for i, (label, v) in enumerate(entries)
        ]
    )
    return _long(agg, [f"k{i}" for i in range(len(entries))])

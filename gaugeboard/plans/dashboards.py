"""The three dashboard styles and the file profile, composed from the operators.

A dashboard is one long table.  Sections: ``kpi`` (title, text), ``chart``
(one row per point) and ``insight`` (series = type, title, text, x_label = severity).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeboard.functions.kinds import categorical_cols, number, number_sql, numeric_cols, quoted
from gaugeboard.functions.text import fmt_integer
from gaugeboard.operators.insights import KEEP, first_half, insight_array, whole_key
from gaugeboard.operators.profile import (
    BINS,
    PREVIEW_ROWS,
    TOP_CATEGORIES,
    bin_of,
    corr_map,
    describe,
    histogram_of,
    moments_sql,
    most_frequent,
    pearson_matrix,
    preview,
    schema_listing,
    shares_of,
    struct_sql,
    top_categories,
)
from gaugeboard.operators.quantiles import middle_facts
from gaugeboard.session import materialize

SCHEMA = (
    "section string, chart_id string, chart_type string, title string, series string, ordinal bigint, "
    "x_label string, x_num double, y double, text string, grid_x bigint, grid_y bigint, grid_w bigint, grid_h bigint"
)
_COLUMNS = [part.split() for part in SCHEMA.split(", ")]


def _shaped(df: DataFrame, **columns: Column | str | int | float | None) -> DataFrame:
    """Project to the dashboard schema; columns not named are NULL."""
    out = []
    for name, type_name in _COLUMNS:
        value = columns.get(name)
        value = value if isinstance(value, Column) else F.lit(value)
        out.append(value.cast(type_name).alias(name))
    return df.select(*out)


def _struct(**columns: Column | str | int | None) -> Column:
    out = []
    for name, type_name in _COLUMNS:
        value = columns.get(name)
        value = value if isinstance(value, Column) else F.lit(value)
        out.append(value.cast(type_name).alias(name))
    return F.struct(*out)


class _Facts:
    """What the sections of a dashboard share, so that each reads the table for its own counts only.

    One scan finds the rows, the moments of all numbers and a sketch of the order's key; the key of the middle
    row takes one more scan, or two if there are too many keys to read out.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[str]):
        self.df, self.numbers, self.category = df, numeric_cols(df), next(iter(categorical_cols(df)), None)
        whole = bool(self.numbers) and whole_key(df, order_by)
        aggs = [F.expr(struct_sql(**moments_sql(df, c), n=f"count({number_sql(df, c)})")).alias(f"m{i}") for i, c in enumerate(self.numbers)]
        aggs += [F.expr(struct_sql(**middle_facts(order_by[0]))).alias("middle")] if whole else []
        found = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
        self.n, self.moments = found["n"], [found[f"m{i}"] for i in range(len(self.numbers))]
        self.in_first = first_half(df, order_by, self.n, found["middle"].asDict() if whole else None) if self.numbers else F.lit(False)

    def low_high(self, i: int) -> tuple[Column, Column]:
        return tuple(F.lit(self.moments[i][end]).cast("double") for end in ("min", "max"))

    def of_columns(self) -> dict[str, dict]:
        """As ``pearson_matrix`` takes them."""
        return {c: {"mean": m["mean"], "low": m["min"], "high": m["max"], "complete": m["n"] == self.n} for c, m in zip(self.numbers, self.moments)}

    def counted(self, **keys: Column) -> DataFrame:
        """Rows per combination of few keys, with what each adds to the half means: a stored table, one scan."""
        halves = []
        for i, c in enumerate(self.numbers):
            for half, rows in (("first", self.in_first), ("second", ~self.in_first)):
                v = F.when(rows, number(self.df, c))
                halves += [F.sum(v).alias(f"{half}_sum{i}"), F.count(v).alias(f"{half}_n{i}")]
        return materialize(self.df.groupBy(*[k.alias(name) for name, k in keys.items()]).agg(F.count(F.lit(1)).alias("count"), *halves), "sections")

    def aggregated(self, counted: DataFrame) -> DataFrame:
        """The one row that ``insight_array`` reads."""
        halves = [
            F.struct(*[F.try_divide(F.sum(f"{half}_sum{i}"), F.sum(f"{half}_n{i}")).alias(half) for half in ("first", "second")]).alias(f"h{i}")
            for i in range(len(self.numbers))
        ]
        moments = [F.struct(*[F.lit(m[f]).cast("double").alias(f) for f in ("mean", "std", "max", "min")]).alias(f"m{i}") for i, m in enumerate(self.moments)]
        return counted.agg(F.lit(self.n).cast("bigint").alias("n"), *halves).select("*", *moments)


def _kpis_and_insights(facts: _Facts, counted: DataFrame, labels: Sequence[str], formatted: bool, keep: int) -> DataFrame:
    """KPI and insight sections."""
    n_cols = len(facts.df.columns)
    rows_text = fmt_integer(F.col("n")) if formatted else F.col("n").cast("string")
    cols_text = F.lit(f"{n_cols:,}" if formatted else str(n_cols))
    kpi_rows = F.array(
        _struct(section="kpi", ordinal=0, title=labels[0], text=rows_text),
        _struct(section="kpi", ordinal=1, title=labels[1], text=cols_text),
    )
    listed = insight_array(facts.df, facts.aggregated(counted), keep, with_columns=[kpi_rows.alias("kpis")])
    insight_rows = F.transform(
        "insights",
        lambda i, at: _struct(
            section="insight",
            series=i.getField("type"),
            title=i.getField("title"),
            ordinal=at,
            text=i.getField("description"),
            x_label=i.getField("severity"),
        ),
    )
    return listed.select(F.inline(F.concat(F.col("kpis"), insight_rows)))


def _bar(facts: _Facts, top: DataFrame | None, grid: dict) -> DataFrame | None:
    if top is None:
        return None
    # At most ten rows reach this window.
    rank = F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("category").asc())) - 1
    return _shaped(
        top.withColumn("rank", rank),
        section="chart",
        chart_id="chart-1",
        chart_type="bar",
        title=f"Top {TOP_CATEGORIES} {facts.category}",
        ordinal=F.col("rank"),
        x_label=F.col("category"),
        y=F.col("count"),
        **grid,
    )


def _binned(facts: _Facts) -> DataFrame:
    """Counts per bin of the first number; one group without numbers."""
    value = number(facts.df, facts.numbers[0]) if facts.numbers else None
    return facts.counted(bin=F.lit(0).cast("bigint") if value is None else bin_of(value, *facts.low_high(0), BINS))


def _histogram(facts: _Facts, binned: DataFrame, grid: dict) -> DataFrame | None:
    if not facts.numbers:
        return None
    return _shaped(
        histogram_of(binned.where(F.col("bin").isNotNull()).select("bin", "count"), *facts.low_high(0)),
        section="chart",
        chart_id="chart-2",
        chart_type="histogram",
        title=f"Distribution of {facts.numbers[0]}",
        ordinal=F.col("bin"),
        x_num=F.col("lo"),
        y=F.col("count"),
        **grid,
    )


def _gridded(facts: _Facts) -> DataFrame:
    """Counts per cell of the first two numbers; one group if there are fewer."""
    if len(facts.numbers) < 2:
        return facts.counted(x_bin=F.lit(0).cast("bigint"))
    x, y = (bin_of(number(facts.df, facts.numbers[i]), *facts.low_high(i), BINS) for i in (0, 1))
    return facts.counted(x_bin=x, y_bin=y)


def _scatter(facts: _Facts, gridded: DataFrame) -> DataFrame | None:
    """First two numeric columns as counts on a grid: series = y bin, x_num = x bin."""
    if len(facts.numbers) < 2:
        return None
    return _shaped(
        gridded.where(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull()),
        section="chart",
        chart_id="ml-scatter",
        chart_type="scatter",
        title=f"Correlation: {facts.numbers[0]} vs {facts.numbers[1]}",
        series=F.col("y_bin"),
        ordinal=F.col("y_bin"),
        x_num=F.col("x_bin"),
        y=F.col("count"),
    )


def _heatmap(facts: _Facts) -> DataFrame | None:
    if len(facts.numbers) < 2:
        return None
    return _shaped(
        pearson_matrix(facts.df, facts=facts.of_columns()),
        section="chart",
        chart_id="ml-heatmap",
        chart_type="heatmap",
        title="Correlation matrix",
        series=F.col("col_a"),
        x_label=F.col("col_b"),
        y=F.col("corr"),
    )


def _pie(facts: _Facts, sums: DataFrame | None) -> DataFrame | None:
    if sums is None or not facts.numbers:
        return None
    return _shaped(
        shares_of(sums),
        section="chart",
        chart_id="chart-3",
        chart_type="pie",
        title=f"{facts.numbers[0]} by {facts.category}",
        x_label=F.col("category"),
        x_num=F.col("share"),
        y=F.col("total"),
    )


def _union(parts: Sequence[DataFrame | None]) -> DataFrame:
    kept = [p for p in parts if p is not None]
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def simple_dashboard(df: DataFrame, order_by: Sequence[str], keep: int = KEEP) -> DataFrame:
    """KPIs, top categories of the first text column, histogram of the first number."""
    facts = _Facts(df, order_by)
    binned = _binned(facts)
    head = _kpis_and_insights(facts, binned, ("Total Rows", "Total Columns"), formatted=True, keep=keep)
    top = top_categories(df, facts.category) if facts.category else None
    return _union([head, _bar(facts, top, {}), _histogram(facts, binned, {})])


def ml_dashboard(df: DataFrame, order_by: Sequence[str], keep: int = KEEP) -> DataFrame:
    """KPIs, scatter grid of the first two numbers, correlation heat map."""
    facts = _Facts(df, order_by)
    gridded = _gridded(facts)
    head = _kpis_and_insights(facts, gridded, ("Dataset Size", "Features"), formatted=False, keep=keep)
    return _union([head, _scatter(facts, gridded), _heatmap(facts)])


def powerbi_dashboard(df: DataFrame, order_by: Sequence[str], keep: int = KEEP) -> DataFrame:
    """The simple dashboard on a grid, with a share-of-total pie; categories are grouped once for both of their charts."""
    first = {"grid_x": 0, "grid_y": 0, "grid_w": 6, "grid_h": 4}
    second = {**first, "grid_x": 6}
    facts = _Facts(df, order_by)
    binned = _binned(facts)
    head = _kpis_and_insights(facts, binned, ("Total Rows", "Total Columns"), formatted=True, keep=keep)
    grouped = None
    if facts.category:
        category = F.col(quoted(facts.category))
        total = F.sum(number(df, facts.numbers[0])) if facts.numbers else F.lit(None).cast("double")
        grouped = materialize(df.groupBy(category.alias("category")).agg(F.count(category).alias("count"), total.alias("total")), "categories")
    bar = _bar(facts, None if grouped is None else most_frequent(grouped), first)
    return _union([head, bar, _histogram(facts, binned, second if bar is not None else first), _pie(facts, grouped)])


STYLES = {"simple": simple_dashboard, "ml": ml_dashboard, "powerbi": powerbi_dashboard}


def dashboard(df: DataFrame, style: str, order_by: Sequence[str], keep: int = KEEP) -> DataFrame:
    """Dashboard rows in a style, with the first ``keep`` insights; an unknown style gives the simple one."""
    return STYLES.get(style, simple_dashboard)(df, order_by, keep)


def document(rows: DataFrame, layout: str) -> DataFrame:
    """The rows of a dashboard as one nested row: layout, kpis, charts with their data, insights.

    A dashboard has few rows however large its table, so the document is small.  Entries come by ordinal, then
    series and label, charts by id; ``grid_pos`` is NULL off the grid.  A section without rows is an empty array.
    """
    is_chart = F.col("section") == "chart"
    entry = F.struct("ordinal", "series", "x_label", "x_num", "y", F.when(~is_chart, F.col("title")).alias("head"), "text")
    keys = ["section", "chart_id", "chart_type", "grid_x", "grid_y", "grid_w", "grid_h"]
    parts = rows.groupBy(*keys, F.when(is_chart, F.col("title")).alias("chart_title")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))

    def listed(**fields: str) -> Column:
        return F.transform("entries", lambda e: F.struct(*[e.getField(source).alias(name) for name, source in fields.items()]))

    def of_section(section: str, **fields: str) -> Column:
        return F.flatten(F.collect_list(F.when(F.col("section") == section, listed(**fields))))

    grid = F.when(F.col("grid_w").isNotNull(), F.struct(*[F.col(f"grid_{c}").alias(c) for c in "xywh"]))
    chart = F.struct(
        F.col("chart_id").alias("id"),
        F.col("chart_type").alias("type"),
        F.col("chart_title").alias("title"),
        listed(series="series", ordinal="ordinal", x_label="x_label", x_num="x_num", y="y").alias("data"),
        grid.alias("grid_pos"),
    )
    found = parts.agg(
        of_section("kpi", label="head", value="text").alias("kpis"),
        F.sort_array(F.collect_list(F.when(is_chart, chart))).alias("charts"),
        of_section("insight", type="series", title="head", description="text", severity="x_label").alias("insights"),
    )
    return found.select(F.lit(layout).alias("layout"), "kpis", "charts", "insights")


def file_profile(df: DataFrame, order_by: Sequence[str], preview_rows: int = PREVIEW_ROWS) -> DataFrame:
    """Schema, summary and preview of a table as (section, ordinal, name, stat, num, text)."""

    def shaped(source: DataFrame, section: str, **cols) -> DataFrame:
        types = {"ordinal": "bigint", "name": "string", "stat": "string", "num": "double", "text": "string"}
        return source.select(
            F.lit(section).alias("section"), *[cols.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()]
        )

    schema = shaped(
        schema_listing(df), "schema", ordinal=F.col("ordinal"), name=F.col("column"), stat=F.lit("values"), num=F.col("n_values"), text=F.col("type")
    )
    stats = ["mean", "std", "min", "max", "median"]
    summary = describe(df).select(
        "ordinal",
        "column",
        F.inline(
            F.array(
                *[F.struct(F.lit(s).alias("stat"), F.col(s).alias("num"), F.lit(None).cast("string").alias("text")) for s in stats],
                *[F.struct(F.lit(s).alias("stat"), F.lit(None).cast("double").alias("num"), F.col(s).alias("text")) for s in ("min_text", "max_text")],
            )
        ),
    )
    summary = shaped(
        summary.where(F.col("num").isNotNull() | F.col("text").isNotNull()),
        "summary", ordinal=F.col("ordinal"), name=F.col("column"), stat=F.col("stat"), num=F.col("num"), text=F.col("text"),
    )
    head = preview(df, order_by, preview_rows)
    # The preview is bounded, so numbering it may use one window.
    numbered = head.select(
        (F.row_number().over(Window.orderBy(*order_by)) - 1).alias("at"), F.to_json(F.struct(*df.columns)).alias("row")
    )
    rows = shaped(numbered, "preview", ordinal=F.col("at"), text=F.col("row"))
    return schema.unionByName(summary).unionByName(rows)


def manifest(df: DataFrame) -> DataFrame:
    """One row: row count, column list, correlations and the time of writing."""
    columns = F.array(
        *[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for f in df.schema.fields]
    )
    numeric = numeric_cols(df)
    correlations = corr_map(df).scalar() if len(numeric) > 1 else F.lit(None).cast("map<string,map<string,double>>")
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count",
        columns.alias("columns"),
        correlations.alias("correlations"),
        F.current_timestamp().alias("generated_at"),
    )

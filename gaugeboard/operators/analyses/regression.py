"""Regression, feature importance and linear attributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from gaugeboard.functions.kinds import number
from gaugeboard.operators.ordered import with_position
from gaugeboard.session import materialize, scratch_scope

SEED = 42
# About as many points of a ROC curve as Spark ML takes for a training summary.
ROC_BINS = 1000


def ols_simple(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and R² of y on x, per group if ``by`` is given."""
    a, b = number(df, y), number(df, x)
    return df.groupBy(*by).agg(
        F.regr_slope(a, b).alias("slope"),
        F.regr_intercept(a, b).alias("intercept"),
        F.regr_r2(a, b).alias("r2"),
        F.regr_count(a, b).alias("n"),
    )


def _complete(df: DataFrame, inputs: Sequence[str], label: Column) -> DataFrame:
    return df.select(*[number(df, c).alias(c) for c in inputs], label.cast("double").alias("label")).dropna()


def _assembled(df: DataFrame, inputs: Sequence[str], label: Column) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(inputs), outputCol="features").transform(_complete(df, inputs, label)).select("features", "label")


def _coefficients(df: DataFrame, names: Sequence[str], values: Sequence[float]) -> DataFrame:
    return df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "term string, coefficient double")


def ols_multi(df: DataFrame, y: str, inputs: Sequence[str]) -> DataFrame:
    """Least-squares coefficients of several inputs, with intercept and R²."""
    from pyspark.ml.regression import LinearRegression

    model = LinearRegression(solver="normal").fit(_assembled(df, inputs, number(df, y)))
    return _coefficients(df, [*inputs, "(intercept)", "(r2)"], [*model.coefficients, model.intercept, model.summary.r2])


def area_under_roc(scored: DataFrame, bins: int = ROC_BINS) -> float:
    """Area under the ROC curve of ``scored`` rows (score, label 0 or 1), by trapezoids.

    As in Spark ML, a point of the curve stands for an equal number of distinct scores, so that there are about ``bins``
    points, and none is joined below twice that many scores.  The scores are counted and put in order by shuffles of
    plain columns; only the points, fewer than twice ``bins``, reach the driver.
    """
    yes = F.sum((F.col("label") > 0.5).cast("long"))
    with scratch_scope(scored.sparkSession):
        counts = scored.groupBy("score").agg(yes.alias("yes"), F.count(F.lit(1)).alias("n"))
        placed = with_position(counts, [F.col("score").desc()], "position", total="scores")
        point = F.expr(f"(position - 1) div greatest(scores div {bins}, 1L)")
        points = placed.groupBy(point.alias("point")).agg(F.sum("yes").alias("yes"), F.sum(F.col("n") - F.col("yes")).alias("no")).orderBy("point").collect()
    all_yes, all_no = sum(p["yes"] for p in points), sum(p["no"] for p in points)
    area, x, y, seen_yes, seen_no = 0.0, 0.0, 0.0, 0, 0
    for p in points:
        seen_yes, seen_no = seen_yes + p["yes"], seen_no + p["no"]
        to_x, to_y = seen_no / all_no if all_no else 0.0, seen_yes / all_yes if all_yes else 0.0
        area, x, y = area + (to_x - x) * (to_y + y) / 2, to_x, to_y
    return area + (1 - x) * (1 + y) / 2


def logistic(df: DataFrame, label: Column, inputs: Sequence[str], max_iter: int = 200, tol: float = 1e-9) -> DataFrame:
    """Logistic regression coefficients for a yes/no label, with area under ROC.

    A fit that is still moving after ``max_iter`` steps is refused.
    """
    from pyspark.ml.classification import LogisticRegression

    label = label.cast("int")
    model = LogisticRegression(maxIter=max_iter, tol=tol).fit(_assembled(df, inputs, label))
    if model.summary.totalIterations >= max_iter:
        raise ValueError(f"no convergence in {max_iter} iterations")
    rows = _complete(df, inputs, label)
    line = sum((F.lit(float(w)) * rows[c] for w, c in zip(model.coefficients, inputs)), F.lit(0.0)) + F.lit(float(model.intercept))
    # The model's probability of a yes, in the steps in which it takes it.
    auc = area_under_roc(rows.select((1 - 1 / (1 + F.exp(line))).alias("score"), "label"))
    return _coefficients(df, [*inputs, "(intercept)", "(auc)"], [*model.coefficients, model.intercept, auc])


def score_equations(df: DataFrame, label: Column, inputs: Sequence[str], fitted: DataFrame) -> DataFrame:
    """Per term of a logistic fit, the mean residual times the input in standard deviations; zero at the most likely fit.

    ``fitted`` is what ``logistic`` returned; one pass for the deviations, one for the sums.
    """
    weight = {r["term"]: r["coefficient"] for r in fitted.collect()}
    rows = df.select(*[number(df, c).alias(f"x{i}") for i, c in enumerate(inputs)], label.cast("int").cast("double").alias("y")).dropna()
    facts = rows.agg(*[F.struct(F.avg(f"x{i}").alias("m"), F.stddev_samp(f"x{i}").alias("s")).alias(f"f{i}") for i in range(len(inputs))]).first()
    line = sum((F.lit(weight[c]) * F.col(f"x{i}") for i, c in enumerate(inputs)), F.lit(weight["(intercept)"]))
    residual = F.col("y") - 1 / (1 + F.exp(-line))
    scaled = {c: (F.col(f"x{i}") - F.lit(facts[f"f{i}"]["m"])) / F.lit(facts[f"f{i}"]["s"] or 1.0) for i, c in enumerate(inputs)}
    scores = [F.struct(F.lit(c).alias("term"), F.avg(residual * x).alias("score")) for c, x in {**scaled, "(intercept)": F.lit(1.0)}.items()]
    agg = rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(scores)])
    return agg.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(scores))])))


def _standardised(rows: DataFrame, inputs: Sequence[str]) -> list[float | None]:
    """Linear coefficients in standard deviations, model and deviations over the same assembled rows."""
    from pyspark.ml.regression import LinearRegression

    linear = LinearRegression(solver="normal").fit(rows)
    values = rows.select("label", vector_to_array("features").alias("f"))
    spread = values.agg(F.stddev_samp("label").alias("y"), *[F.stddev_samp(F.col("f")[i]).alias(f"x{i}") for i in range(len(inputs))]).first()
    return [float(linear.coefficients[i] * spread[f"x{i}"] / spread["y"]) if spread["y"] else None for i in range(len(inputs))]


def standard_coefficients(df: DataFrame, y: str, inputs: Sequence[str]) -> DataFrame:
    """Per input the linear coefficient in standard deviations, over the rows without gaps."""
    rows = materialize(_assembled(df, inputs, number(df, y)), "assembled")
    return df.sparkSession.createDataFrame(list(zip(inputs, _standardised(rows, inputs))), "feature string, std_coefficient double")


def feature_importance(
    df: DataFrame, y: str, inputs: Sequence[str], seed: int = SEED, trees: int = 10, depth: int = 5
) -> DataFrame:
    """Per input: standardised linear coefficient and random-forest importance, over the rows without gaps."""
    from pyspark.ml.regression import RandomForestRegressor

    rows = materialize(_assembled(df, inputs, number(df, y)), "assembled")
    weights = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(rows).featureImportances.toArray()
    table = [(c, std, float(w)) for c, std, w in zip(inputs, _standardised(rows, inputs), weights)]
    return df.sparkSession.createDataFrame(table, "feature string, std_coefficient double, importance double")


def linear_shap(df: DataFrame, y: str, x: str, key: Sequence[str]) -> DataFrame:
    """Exact attribution of a one-input linear model: slope * (x - mean x) per row."""
    fitted = df.agg(F.struct(F.regr_slope(number(df, y), number(df, x)).alias("w"), F.regr_avgx(number(df, y), number(df, x)).alias("m"))).scalar()
    phi = fitted.getField("w") * (number(df, x) - fitted.getField("m"))
    return df.select(*key, phi.alias("phi"))


def linear_shap_multi(df: DataFrame, y: str, inputs: Sequence[str]) -> DataFrame:
    """Mean absolute attribution per input of a linear model with several inputs."""
    from pyspark.ml.regression import LinearRegression

    rows = _assembled(df, inputs, number(df, y))
    model = LinearRegression(solver="normal").fit(rows)
    means = rows.select(vector_to_array("features").alias("f")).agg(*[F.avg(F.col("f")[i]).alias(f"m{i}") for i in range(len(inputs))]).first()
    phi = [F.abs(F.lit(float(model.coefficients[i])) * (F.col("f")[i] - F.lit(means[f"m{i}"]))) for i in range(len(inputs))]
    agg = rows.select(vector_to_array("features").alias("f")).agg(
        *[F.struct(F.lit(c).alias("feature"), F.avg(phi[i]).alias("mean_abs_phi")).alias(f"s{i}") for i, c in enumerate(inputs)]
    )
    return agg.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(inputs))])))

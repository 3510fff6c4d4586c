"""Time series: period sums, smoothing, seasonality, decomposition, forecasts.

The raw table is reduced to one row per period (and series) first, and the calendar
between a series' first and last period is filled, so neighbouring rows are
neighbouring periods.  A calendar bounds the number of periods, so windows over
them stay small; series are independent and spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeboard.session import materialize

SEASON = 12
ALPHA = 0.3
HORIZON = 3


# Steps of the calendar by name of the period.
STEPS = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR"}


def periods(
    df: DataFrame, ts: str, value: Column, grain: str = "month", series: Sequence[str] = (), fill: float | None = 0.0
) -> DataFrame:
    """Sum per period: (series..., period, y, t) with t counting the periods since the series' first.

    Periods without rows get ``fill`` (None: NULL); rows without a time are left out.
    The short result is stored, as most uses of it read it more than once.
    """
    day = F.date_trunc(grain, F.col(ts)).cast("date")
    sums = df.groupBy(*series, day.alias("period")).agg(F.sum(value).alias("y")).where(F.col("period").isNotNull())
    sums = materialize(sums, "sums")
    ends = sums.groupBy(*series).agg(F.min("period").alias("__first"), F.max("period").alias("__last"))
    calendar = F.posexplode(F.sequence("__first", "__last", F.expr(STEPS[grain]))).alias("__t", "__period")
    every = ends.where(F.col("__first").isNotNull()).select(*[F.col(s).alias(f"__k_{s}") for s in series], calendar)
    same = F.col("period") == F.col("__period")
    for s in series:
        same = same & F.col(s).eqNullSafe(F.col(f"__k_{s}"))
    y = F.when(F.col("period").isNull(), F.lit(fill)).otherwise(F.col("y")).cast(sums.schema["y"].dataType)
    filled = every.join(sums, same, "left")
    keys = [F.col(f"__k_{s}").alias(s) for s in series]
    return materialize(filled.select(*keys, F.col("__period").alias("period"), y.alias("y"), F.col("__t").cast("bigint").alias("t")), "periods")


def moving_average(p: DataFrame, series: Sequence[str] = (), before: int = 1, after: int = 1) -> DataFrame:
    """Centred moving average of y."""
    order = Window.partitionBy(*series).orderBy("t")
    return p.withColumn("moving_avg", F.avg("y").over(order.rowsBetween(-before, after)))


def growth(p: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Change and growth rate against the previous period; the rate is missing after a period of 0."""
    order = Window.partitionBy(*series).orderBy("t")
    before = F.lag("y").over(order)
    return p.withColumns({"delta": F.col("y") - before, "growth": F.try_divide(F.col("y") - before, before)})


def trend_line(p: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope and intercept of y over t."""
    slope, intercept = F.regr_slope("y", "t"), F.regr_intercept("y", "t")
    return p.groupBy(*series).agg(slope.alias("slope"), intercept.alias("intercept"), F.count(F.lit(1)).alias("n"))


def _trend(p: DataFrame, series: Sequence[str], season: int) -> DataFrame:
    """Add the centred trend: the mean of two season-long averages half a step apart."""
    half = season // 2
    order = Window.partitionBy(*series).orderBy("t")
    wide, inner = order.rowsBetween(-half, half), order.rowsBetween(-half + 1, half - 1)
    ends = F.sum("y").over(wide) - F.sum("y").over(inner)
    full = F.count("y").over(wide) == season + 1
    return p.withColumn("trend", F.when(full, (F.sum("y").over(inner) + ends / 2) / season))


def _seasonal(detrended: DataFrame, series: Sequence[str], season: int) -> DataFrame:
    """Mean detrended value per place in the season, shifted to average 0."""
    means = detrended.groupBy(*series, "place").agg(F.avg("detrended").alias("raw"))
    level = F.avg("raw").over(Window.partitionBy(*series))
    return means.select(*series, "place", (F.col("raw") - level).alias("seasonal"))


def _detrended(p: DataFrame, series: Sequence[str], season: int) -> DataFrame:
    place = F.month("period").cast("bigint") if season == 12 else F.col("t") % season
    return _trend(p, series, season).withColumns({"detrended": F.col("y") - F.col("trend"), "place": place})


def seasonality(p: DataFrame, series: Sequence[str] = (), season: int = SEASON) -> DataFrame:
    """Seasonal index per place in the season (month of the year for 12)."""
    return _seasonal(_detrended(p, series, season), series, season)


def decompose(p: DataFrame, series: Sequence[str] = (), season: int = SEASON) -> DataFrame:
    """Additive decomposition: y = trend + seasonal + residual."""
    parts = _detrended(p, series, season)
    index = _seasonal(parts, series, season)
    joined = parts.join(index, [*series, "place"])
    return joined.withColumn("residual", F.col("y") - F.col("trend") - F.col("seasonal")).drop("detrended", "place")


def exponential_smoothing(p: DataFrame, series: Sequence[str] = (), alpha: float = ALPHA) -> DataFrame:
    """Level after the last period, which is the forecast for all later ones.

    Periods without a value leave the level as it is.  One array per series, as long as its number of periods.
    """
    ordered = F.array_sort(F.collect_list(F.when(F.col("y").isNotNull(), F.struct("t", "y"))))
    folded = F.aggregate(
        F.slice(F.col("__s"), F.lit(2), F.greatest(F.size("__s") - 1, F.lit(0))),
        F.get("__s", F.lit(0)).getField("y"),
        lambda level, point: F.lit(alpha) * point.getField("y") + F.lit(1 - alpha) * level,
    )
    return p.groupBy(*series).agg(ordered.alias("__s")).select(*series, folded.alias("forecast"))


def _steps(horizon: int) -> Column:
    return F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(horizon).cast("bigint")))


def _future(p: DataFrame, series: Sequence[str], horizon: int) -> DataFrame:
    last = p.groupBy(*series).agg(F.max("t").alias("__last"))
    return last.select(*series, "__last", _steps(horizon).alias("step"))


def seasonal_naive(p: DataFrame, series: Sequence[str] = (), season: int = SEASON, horizon: int = HORIZON) -> DataFrame:
    """The value one season before each future period."""
    past = p.select(*series, F.col("t").alias("__t"), F.col("y").alias("forecast"))
    steps = _future(p, series, horizon)
    source = F.col("__last") + F.col("step") - season * F.ceil(F.col("step") / season)
    steps = steps.withColumn("__t", source)
    return steps.join(past, [*series, "__t"], "left").select(*series, "step", "forecast")


def linear_forecast(p: DataFrame, series: Sequence[str] = (), horizon: int = HORIZON) -> DataFrame:
    """The trend line continued."""
    slope, intercept = F.regr_slope("y", "t"), F.regr_intercept("y", "t")
    lines = p.groupBy(*series).agg(slope.alias("__m"), intercept.alias("__b"), F.max("t").alias("__last"))
    steps = lines.withColumn("step", _steps(horizon))
    return steps.select(*series, "step", (F.col("__b") + F.col("__m") * (F.col("__last") + F.col("step"))).alias("forecast"))

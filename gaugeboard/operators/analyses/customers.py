"""Customer analyses: recency-frequency-money, segments, cohorts, funnels, ABC classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeboard.operators.ordered import running_totals
from gaugeboard.operators.quantiles import NO_KEY, rows_at_ranks
from gaugeboard.session import materialize

CLASS_A, CLASS_B = 0.80, 0.95
SCORES = 5
CLUSTERS = 4
SEED = 42


def rfm_features(sales: DataFrame, customer: str, ts: str, amount: str, now: Column) -> DataFrame:
    """Days since the last sale, number of sales and money per customer."""
    return sales.groupBy(customer).agg(
        F.date_diff(now, F.max(ts)).cast("bigint").alias("recency"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum(amount).alias("monetary"),
    )


def rfm(features: DataFrame, customer: str, scores: int = SCORES) -> DataFrame:
    """Quantile scores 1..5 for recency (recent is high), frequency and money; ties go by the customer's whole number.

    Missing values are the lowest.  The last row of each score but the highest is searched, for all three
    features at once (``rows_at_ranks``), and scores are read off by comparing with them: no row is moved.
    """
    stored = materialize(features, "features")
    lowest = "CAST('-Infinity' AS DOUBLE)"
    orders = {name: f"coalesce(nanvl({sql}, NULL), {lowest})" for name, sql in (("r", "CAST(-recency AS DOUBLE)"), ("f", "CAST(frequency AS DOUBLE)"), ("m", "CAST(monetary AS DOUBLE)"))}
    small, larger = divmod(stored.count(), scores)
    # As ntile does, the first ``larger`` scores hold a row more.
    cuts = rows_at_ranks(stored, orders, customer, [small * i + min(i, larger) - 1 for i in range(1, scores)])
    place = F.coalesce(F.col(customer).cast("long"), F.lit(NO_KEY))

    def score(name: str) -> Column:
        over = [(F.struct(F.expr(orders[name]).alias("v"), place.alias("k")) > F.struct(F.lit(v).alias("v"), F.lit(k).cast("long").alias("k"))).cast("long") for v, k in cuts[name]]
        return sum(over, F.lit(1).cast("long"))

    return stored.withColumns({name: score(name) for name in orders})


def _scaled(features: DataFrame, inputs: Sequence[str], centre: float = 0.0) -> DataFrame:
    """Adds ``features``: the inputs with mean ``centre`` and deviation 1 (a constant input: all ``centre``)."""
    from pyspark.ml.feature import VectorAssembler

    # Stored, because scaling, fitting and assigning each read the features.
    stored = materialize(features, "features")
    facts = stored.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(f"f{i}") for i, c in enumerate(inputs)]).first()
    scaled = stored
    for i, c in enumerate(inputs):
        mean, spread = facts[f"f{i}"]["m"], facts[f"f{i}"]["s"] or 1.0
        scaled = scaled.withColumn(f"__x{i}", (F.col(c) - F.lit(mean)) / F.lit(spread) + F.lit(centre))
    names = [f"__x{i}" for i in range(len(inputs))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(scaled).drop(*names)


def kmeans_segments(
    features: DataFrame, inputs: Sequence[str], k: int = CLUSTERS, seed: int = SEED, max_iter: int = 100, tol: float = 1e-6
) -> DataFrame:
    """K-means on standardised features; adds ``segment``."""
    from pyspark.ml.clustering import KMeans

    scaled = _scaled(features, inputs)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, predictionCol="segment").fit(scaled)
    return model.transform(scaled).drop("features")


def bisecting_segments(
    features: DataFrame, inputs: Sequence[str], k: int = CLUSTERS, seed: int = SEED, max_iter: int = 100
) -> DataFrame:
    """Hierarchical segments by repeated splitting; adds ``segment``."""
    from pyspark.ml.clustering import BisectingKMeans

    # The first split moves off the centre in proportion to it, so the centre must not be zero.
    scaled = _scaled(features, inputs, centre=1.0)
    model = BisectingKMeans(k=k, seed=seed, maxIter=max_iter, predictionCol="segment").fit(scaled)
    return model.transform(scaled).drop("features")


def segment_quality(segmented: DataFrame, inputs: Sequence[str], segment: str = "segment") -> DataFrame:
    """Per segment: rows, inertia (squared distances to its centre, inputs in standard deviations), spread of all rows
    around the common centre, and how many rows are nearer to another segment's centre.

    Centres are the means of the segments, so a converged K-means has no such rows.
    """
    facts = segmented.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(f"f{i}") for i, c in enumerate(inputs)]).first()
    scaled = segmented.select(
        F.col(segment).alias("segment"), *[((F.col(c) - F.lit(facts[f"f{i}"]["m"])) / F.lit(facts[f"f{i}"]["s"] or 1.0)).alias(f"x{i}") for i, c in enumerate(inputs)]
    )
    centres = scaled.groupBy("segment").agg(*[F.avg(f"x{i}").alias(f"c{i}") for i in range(len(inputs))]).collect()  # one row per segment

    def away(row) -> Column:
        return sum(((F.col(f"x{i}") - F.lit(row[f"c{i}"])) ** 2 for i in range(len(inputs))), F.lit(0.0))

    own = F.coalesce(*[F.when(F.col("segment") == row["segment"], away(row)) for row in centres], F.lit(0.0))
    nearest = F.least(*[away(row) for row in centres], F.lit(float("inf")))
    spread = sum((F.col(f"x{i}") ** 2 for i in range(len(inputs))), F.lit(0.0))
    return scaled.groupBy("segment").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(own).alias("inertia"), F.sum(spread).alias("spread"), F.count_if(own > nearest * (1 + 1e-9)).alias("misplaced")
    )


def cohort_retention(events: DataFrame, user: str, ts: str, grain: str = "quarter") -> DataFrame:
    """Active users per cohort (period of first activity) and periods since, with rates.

    Events shrink to one row per user and period before anything is joined.
    """
    months = {"month": 1, "quarter": 3, "year": 12}[grain]
    active = events.select(F.col(user).alias("__u"), F.date_trunc(grain, F.col(ts)).cast("date").alias("__p")).distinct()
    # A user has at most one row per period here, so the window holds few of them.
    started = active.withColumn("cohort", F.min("__p").over(Window.partitionBy("__u")))
    apart = (F.year("__p") - F.year("cohort")) * 12 + F.month("__p") - F.month("cohort")
    cells = started.groupBy("cohort", F.floor(apart / months).cast("bigint").alias("period")).agg(
        F.count(F.lit(1)).alias("users")
    )
    # Everyone in a cohort is active in its first period.
    size = F.max(F.when(F.col("period") == 0, F.col("users"))).over(Window.partitionBy("cohort"))
    sized = cells.withColumn("cohort_size", size)
    rate = F.try_divide(F.col("users"), F.col("cohort_size"))
    return sized.select("cohort", "period", "users", "cohort_size", rate.alias("retention"))


def cohort_churn(events: DataFrame, user: str, ts: str, grain: str = "quarter") -> DataFrame:
    """Share of each cohort that is not active, per period since it began."""
    kept = cohort_retention(events, user, ts, grain)
    return kept.select("cohort", "period", (F.col("cohort_size") - F.col("users")).alias("lost"), (1 - F.col("retention")).alias("churn"))


def funnel(events: DataFrame, entity: Sequence[str], step_col: str, steps: Sequence[str], ts: str) -> DataFrame:
    """How many entities reach each step, every step strictly later than the one before.

    Reaching a step at its earliest possible time is best for all later ones, so
    each step is a minimum over events after the previous step's time.  The times are
    stored per step, so every step's events are read once.
    """
    entity = list(entity)
    reached: list[DataFrame] = []
    for step in steps:
        rows = events.where(F.col(step_col) == step).select(*entity, F.col(ts).alias("__ts"))
        if reached:
            rows = rows.join(reached[-1].withColumnRenamed("__at", "__before"), entity).where(F.col("__ts") > F.col("__before"))
        reached.append(materialize(rows.groupBy(*entity).agg(F.min("__ts").alias("__at")), "funnel"))
    counts = None
    for i, (step, table) in enumerate(zip(steps, reached)):
        part = table.agg(F.count(F.lit(1)).alias("entities")).select(
            F.lit(i + 1).cast("bigint").alias("step_no"), F.lit(step).alias("step"), "entities"
        )
        counts = part if counts is None else counts.unionByName(part)
    # One row per step: the rates compare neighbouring rows of this tiny table.
    by_step = Window.orderBy("step_no")
    return counts.select(
        "step_no",
        "step",
        "entities",
        F.try_divide("entities", F.lag("entities").over(by_step)).alias("step_rate"),
        F.try_divide("entities", F.first("entities").over(by_step)).alias("total_rate"),
    )


def abc_classes(items: DataFrame, key: str, value: str) -> DataFrame:
    """Items by falling value with cumulative share and class A, B or C."""
    ordered = running_totals(items.select(key, value), [], [F.col(value).desc(), F.col(key).asc()], {"cumulative": value})
    # The total of the stored ranges: the items are not computed again.
    total = ordered.agg(F.sum(value)).scalar()
    share = F.try_divide(F.col("cumulative"), total)
    return ordered.select(
        key,
        value,
        share.alias("cum_share"),
        F.when(share <= CLASS_A, "A").when(share <= CLASS_B, "B").otherwise("C").alias("class"),
    )


def abc_summary(items: DataFrame, key: str, value: str) -> DataFrame:
    """Items and value per class."""
    return abc_classes(items, key, value).groupBy("class").agg(F.count(F.lit(1)).alias("items"), F.sum(value).alias("value"))

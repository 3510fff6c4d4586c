"""Positions, running totals and neighbours over a global order.

A window without partition keys pulls the table into one task, and a window on
a hot key pulls that key into one task.  The helpers here range-partition the
rows instead, so a hot group is spread over as many ranges as it needs, then
carry small facts (one row per range) from range to range.

``order_by`` must identify rows uniquely for results to be reproducible; add a
tie-breaker where it does not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeboard.session import materialize

_RANGE = "__range"
_ROW = "__row"
# monotonically_increasing_id keeps the row number in its low 33 bits.
_ROW_MASK = (1 << 33) - 1
# Input bytes per range and the most ranges asked for.
RANGE_BYTES = 128 * 1024 * 1024
MOST_RANGES = 100_000
# Groups of more rows than this are split over ranges.  It decides the plan only: windows and ranges give the
# same values (tests/test_ordered.py compares them), and a window spills, so the figure is no limit.
LARGE_GROUP = 1_000_000


def _columns(keys: Sequence[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def _input_bytes(df: DataFrame) -> int:
    """Size of the files and tables a query reads, as far as Spark knows it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    unknown = 1 << 60
    return sum(size for size in sizes if size < unknown)


def _by_range(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Range partitions of a bounded size.

    Normally the session's shuffle partitions are used, and adaptive execution joins
    small ones.  More are asked for when the size of the input needs them.
    """
    needed = _input_bytes(df) // RANGE_BYTES
    if needed > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartitionByRange(min(needed, MOST_RANGES), *keys)
    return df.repartitionByRange(*keys)


def has_large_group(df: DataFrame, group_by: Sequence[str], large_group: int | None = None) -> bool:
    """Does any group hold too many rows for one task?  Counts before it shuffles."""
    sizes = df.groupBy(*group_by).agg(F.count(F.lit(1)).alias("__n"))
    limit = LARGE_GROUP if large_group is None else large_group
    return not sizes.where(F.col("__n") > limit).isEmpty()


def _ranges(df: DataFrame, order_by: Sequence[str | Column], label: str) -> DataFrame:
    """Fixed copy of ``df`` in global order, tagged with range and row-in-range."""
    keys = _columns(order_by)
    return materialize(
        _by_range(df, keys)
        .sortWithinPartitions(*keys)
        .withColumn(_RANGE, F.spark_partition_id())
        .withColumn(_ROW, F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_MASK))),
        label,
    )


def with_position(
    df: DataFrame, order_by: Sequence[str | Column], name: str = "position", total: str | None = None
) -> DataFrame:
    """Add the 1-based global position of each row, and optionally the row count.

    Equal to ``row_number() over (order by ...)``: one range shuffle, one narrow
    pass for the range sizes, and a broadcast of one row per range.
    """
    ranges = _ranges(df, order_by, "position")
    by_range = Window.orderBy(_RANGE)
    sizes = ranges.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(
        _RANGE,
        F.coalesce(F.sum("__n").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__total"),
    )
    out = ranges.join(F.broadcast(offsets), _RANGE).withColumn(name, F.col("__before") + F.col(_ROW) + 1)
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop(_RANGE, _ROW, "__before", "__total")


def running_totals(
    df: DataFrame,
    group_by: Sequence[str],
    order_by: Sequence[str | Column],
    sums: dict[str, str | Column],
    large_group: int | None = None,
) -> DataFrame:
    """Add inclusive running sums within each group, in order.

    NULL values add nothing; a sum is NULL until its group has had a value.  NULL is a group like any other.

    Groups that fit a task take one shuffle and a window.  With a larger group, or
    none at all, rows are cut into ranges.  Only the first group of a range can have rows in
    earlier ranges, and it is then the last group of each of them.  So the sum carried into a range is the
    running sum of the tails of its predecessors with that group: one row per range.
    """
    values = {out: (F.col(v) if isinstance(v, str) else v) for out, v in sums.items()}
    if group_by and not has_large_group(df, group_by, large_group):
        inside = Window.partitionBy(*group_by).orderBy(*_columns(order_by)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({out: F.sum(v).over(inside) for out, v in values.items()})
    prepared = df.select("*", *[v.alias(f"__v_{out}") for out, v in values.items()])
    ranges = _ranges(prepared, [*group_by, *order_by], "running")
    group = F.struct(*[F.col(g) for g in group_by]) if group_by else F.struct(F.lit(0))

    per_group = ranges.groupBy(_RANGE, group.alias("__g")).agg(
        F.min(_ROW).alias("__first"), *[F.sum(f"__v_{out}").alias(f"__s_{out}") for out in values]
    )
    tails = F.struct(F.col("__g"), *[F.col(f"__s_{out}") for out in values])
    edges = per_group.groupBy(_RANGE).agg(
        F.min_by("__g", "__first").alias("__head"), F.max_by(tails, "__first").alias("__tail")
    )
    same_tail = Window.partitionBy("__tail.__g").orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, 0)
    by_range = Window.orderBy(_RANGE)
    edges = edges.select(
        _RANGE,
        "__head",
        F.col("__tail.__g").alias("__tail_g"),
        *[F.sum(f"__tail.__s_{out}").over(same_tail).alias(f"__t_{out}") for out in values],
    )
    follows = F.lag("__tail_g").over(by_range).eqNullSafe(F.col("__head"))
    carried = edges.select(
        _RANGE,
        F.col("__head"),
        *[F.when(follows, F.lag(f"__t_{out}").over(by_range)).alias(f"__c_{out}") for out in values],
    )
    inside = Window.partitionBy(_RANGE, *group_by).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, 0)
    out = ranges.join(F.broadcast(carried), _RANGE)
    for name in values:
        carry = F.when(group.eqNullSafe(F.col("__head")), F.col(f"__c_{name}"))
        own = F.sum(f"__v_{name}").over(inside)
        out = out.withColumn(name, F.coalesce(own + carry, own, carry))
    extra = [f"__v_{n}" for n in values] + [f"__c_{n}" for n in values]
    return out.drop(_RANGE, _ROW, "__head", *extra)


def position_in_group(
    df: DataFrame,
    group_by: Sequence[str],
    order_by: Sequence[str | Column],
    name: str = "position",
    large_group: int | None = None,
) -> DataFrame:
    """``row_number()`` per group, safe when one group holds much of the table."""
    return running_totals(df, group_by, order_by, {name: F.lit(1).cast("bigint")}, large_group)


def with_neighbour(
    df: DataFrame,
    group_by: Sequence[str],
    order_by: Sequence[str],
    columns: dict[str, str],
    following: bool = False,
    large_group: int | None = None,
) -> DataFrame:
    """Add values of the previous (or following) row of the same group.

    ``columns`` maps output name to source column.  Equal to ``lag`` / ``lead``
    per group, and just that if every group fits a task.  Otherwise rows are cut into
    ranges, and the row across a border comes from a one-row-per-range table.
    """
    shift = F.lead if following else F.lag
    if not has_large_group(df, group_by, large_group):
        order = Window.partitionBy(*group_by).orderBy(*order_by)
        return df.withColumns({out: shift(c).over(order) for out, c in columns.items()})
    ranges = _ranges(df, [*group_by, *order_by], "neighbour")
    seen = F.struct(*[F.col(g) for g in group_by], *[F.col(c).alias(f"__n_{out}") for out, c in columns.items()])
    edge_row = F.min_by if following else F.max_by
    edges = ranges.groupBy(_RANGE).agg(
        edge_row(seen, F.col(_ROW)).alias("__edge_row"), F.max(_ROW).alias("__last")
    )
    border = edges.select(
        _RANGE, "__last", shift("__edge_row").over(Window.orderBy(_RANGE)).alias("__across")
    )
    tagged = ranges.withColumn("__seen", seen).withColumn(
        "__near", shift("__seen").over(Window.partitionBy(_RANGE).orderBy(_ROW))
    )
    joined = tagged.join(F.broadcast(border), _RANGE)
    at_border = F.col(_ROW) == (F.col("__last") if following else F.lit(0))
    joined = joined.withColumn("__near", F.when(at_border, F.col("__across")).otherwise(F.col("__near")))
    same = F.lit(True)
    for g in group_by:
        same = same & F.col(f"__near.{g}").eqNullSafe(F.col(g))
    same = F.col("__near").isNotNull() & same
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[F.when(same, F.col(f"__near.__n_{out}")).alias(out) for out in columns],
    )


def bucket_of(position: Column, total: Column, buckets: int) -> Column:
    """``ntile(buckets)`` from a 1-based position and the row count."""
    small = F.floor(total / buckets)
    larger = total % buckets
    in_larger = larger * (small + 1)
    return (
        F.when(position <= in_larger, F.floor((position - 1) / (small + 1)) + 1)
        .otherwise(larger + F.floor(F.try_divide(position - 1 - in_larger, small)) + 1)
        .cast("bigint")
    )

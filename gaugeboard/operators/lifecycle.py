"""Status logs: current status, time spent in a status, forbidden transitions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gaugeboard.operators.catalog import extreme_child
from gaugeboard.operators.ordered import with_neighbour

# The life cycle of an uploaded file.
FILE_TRANSITIONS = (("pending", "processing"), ("processing", "completed"), ("processing", "failed"))


def current_status(log: DataFrame, entity: str, status: str, order_by: Sequence[str]) -> DataFrame:
    """The latest status of each entity."""
    rows = log.select(entity, *order_by, status)
    return extreme_child(rows, entity, order_by)


def dwell_times(log: DataFrame, entity: str, status: str, ts: str, order_by: Sequence[str]) -> DataFrame:
    """Each status with the time of the next one and the seconds in between."""
    rows = log.select(entity, *dict.fromkeys([ts, *order_by]), status)
    spanned = with_neighbour(rows, [entity], order_by, {"until": ts}, following=True)
    return spanned.withColumn("seconds", F.timestamp_diff("MICROSECOND", F.col(ts), F.col("until")) / F.lit(1e6))


def status_mean_dwell(log: DataFrame, entity: str, status: str, ts: str, order_by: Sequence[str]) -> DataFrame:
    """Mean time spent in each status, over completed stays."""
    return (
        dwell_times(log, entity, status, ts, order_by)
        .groupBy(status)
        .agg(F.count("seconds").alias("stays"), F.avg("seconds").alias("mean_seconds"))
    )


def forbidden_transitions(
    log: DataFrame, entity: str, status: str, order_by: Sequence[str], allowed: Iterable[tuple[str, str]] = FILE_TRANSITIONS
) -> DataFrame:
    """Status changes outside the allowed pairs, with the status before."""
    rows = log.select(entity, *order_by, status)
    steps = with_neighbour(rows, [entity], order_by, {"previous": status}).where(F.col("previous").isNotNull())
    fine: Column = F.lit(False)
    for before, after in allowed:
        fine = fine | ((F.col("previous") == before) & (F.col(status) == after))
    return steps.where(~fine)

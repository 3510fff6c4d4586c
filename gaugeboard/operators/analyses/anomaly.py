"""Anomalous rows by z-score and by quartile fences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gaugeboard.functions.kinds import number, quoted
from gaugeboard.operators.quantiles import exact_quantiles, grouped_quantiles

Z = 3.0
FENCE = 1.5


def zscore_rows(df: DataFrame, col: str, z: float = Z) -> DataFrame:
    """Rows more than ``z`` standard deviations from the mean; two scans, no shuffle of rows."""
    value = number(df, col)
    m = df.agg(F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))).scalar()
    score = F.try_divide(value - m.getField("mean"), m.getField("std"))
    return df.withColumn("z", score).where(F.abs("z") > z)


def iqr_rows(df: DataFrame, col: str, k: float = FENCE) -> DataFrame:
    """Rows beyond the quartiles by more than ``k`` interquartile ranges."""
    q1, q3 = exact_quantiles(df, [col], [0.25, 0.75])[col]
    if q1 is None:
        return df.limit(0)
    reach = k * (q3 - q1)
    value = number(df, col)
    return df.where((value < F.lit(q1 - reach)) | (value > F.lit(q3 + reach)))


def iqr_rows_by_group(df: DataFrame, group_by: Sequence[str], col: str, k: float = FENCE) -> DataFrame:
    """As ``iqr_rows`` with the quartiles of each row's own group; NULL is a group too."""
    fences = grouped_quantiles(df, group_by, col, {"__q1": 0.25, "__q3": 0.75})
    reach = F.lit(k) * (F.col("__q3") - F.col("__q1"))
    keys = [F.col(quoted(g)).alias(f"__k{i}") for i, g in enumerate(group_by)]
    fences = fences.select(*keys, (F.col("__q1") - reach).alias("lower"), (F.col("__q3") + reach).alias("upper"))
    value, same = number(df, col), F.lit(True)
    for i, g in enumerate(group_by):
        same = same & F.col(quoted(g)).eqNullSafe(F.col(f"__k{i}"))
    found = df.join(fences, same).where((value < F.col("lower")) | (value > F.col("upper")))
    return found.drop(*[f"__k{i}" for i in range(len(group_by))])

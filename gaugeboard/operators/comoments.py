"""Centred second moments of pairs of columns, which add up across batches, tasks and stored states.

A row (n, mean_x, mean_y, xx, yy, xy, low_x, high_x, low_y, high_y) describes the rows in which both columns
of a pair are present.  Sums of squares and products are taken around the means of those very rows, never
around a column's overall mean, so neither offsets nor gaps cost digits.  ``merge_moments`` joins rows
by the differences of their means.  A side is flat if its least value is its largest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugeboard.functions.kinds import number_sql

MOMENTS = ("mean_x", "mean_y", "xx", "yy", "xy", "low_x", "high_x", "low_y", "high_y")
SCHEMA = "i int, j int, n long, " + ", ".join(f"{m} double" for m in MOMENTS)


def batch_moments(values: np.ndarray) -> dict[str, np.ndarray]:
    """k x k arrays of all moments of some rows (NaN: missing); entry [i, j] has column i as x.

    Columns with the same gaps are worked on together, by one matrix product for each kind of gaps.
    """
    there = ~np.isnan(values)
    k = values.shape[1]
    out, rest = {m: np.zeros((k, k)) for m in ("n", *MOMENTS)}, np.zeros((k, k))
    patterns, of = np.unique(there, axis=1, return_inverse=True)
    of = of.ravel()
    for g in range(patterns.shape[1]):
        rows, own = patterns[:, g], np.flatnonzero(of == g)
        x, m = values[rows], there[rows]
        n = m.sum(0)
        safe = np.maximum(n, 1)
        low, high = (f(np.where(m, x, end), axis=0, initial=end) for f, end in ((np.min, np.inf), (np.max, -np.inf)))
        flat = ~(low < high)
        mean = np.where(flat & (n > 0), low, np.where(m, x, 0).sum(0) / safe)
        apart = np.where(m, x - mean, 0)
        products = apart.T @ apart[:, own]
        square = (apart * apart).sum(0)
        for at, value in (("n", n), ("mean_x", mean), ("xx", square), ("low_x", low), ("high_x", high)):
            out[at][:, own] = value[:, None]
        out["xy"][:, own], rest[:, own] = products, apart.sum(0)[:, None]
    # In [i, j] only i is centred by the pair's rows, j by all of its own.  That changes nothing but for what rounding
    # leaves of the sum of i's deviations; of the two sides the one is taken that had less to correct.
    away = out["mean_x"].T - np.diag(out["mean_x"])
    out["xy"] -= rest * away
    risk = np.abs(away) * np.sqrt(out["xx"])
    out["xy"] = np.where(risk <= risk.T, out["xy"], out["xy"].T)
    for x, y in (("mean_x", "mean_y"), ("xx", "yy"), ("low_x", "low_y"), ("high_x", "high_y")):
        out[y] = out[x].T.copy()
    out["xy"] = (out["xy"] + out["xy"].T) / 2
    return out


def _joined(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    n = a["n"] + b["n"]
    share = b["n"] / np.maximum(n, 1)
    dx, dy = b["mean_x"] - a["mean_x"], b["mean_y"] - a["mean_y"]
    weight = a["n"] * share
    out = {"n": n, "mean_x": a["mean_x"] + dx * share, "mean_y": a["mean_y"] + dy * share}
    out |= {"xx": a["xx"] + b["xx"] + dx * dx * weight, "yy": a["yy"] + b["yy"] + dy * dy * weight, "xy": a["xy"] + b["xy"] + dx * dy * weight}
    return out | {c: f(a[c], b[c]) for f, ends in ((np.minimum, ("low_x", "low_y")), (np.maximum, ("high_x", "high_y"))) for c in ends}


def _moment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            found = batch_moments(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float))
            total = found if total is None else _joined(total, found)
    if total is not None:
        i, j = np.triu_indices(len(total["n"]))
        some = total["n"][i, j] > 0
        i, j = i[some], j[some]
        fields = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total["n"][i, j].astype(np.int64))]
        yield pa.RecordBatch.from_arrays([*fields, *[pa.array(total[m][i, j]) for m in MOMENTS]], ["i", "j", "n", *MOMENTS])


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Moments of all pairs i <= j of the columns that have rows in common: one scan, one row per pair and task."""
    numbers = [f"{number_sql(df, c)} AS c{i}" for i, c in enumerate(cols)]
    return df.selectExpr(*numbers).mapInArrow(_moment_rows, SCHEMA)


def _sum_of(a: Column, b: Column) -> Column:
    n = a["n"] + b["n"]
    share = b["n"] / F.greatest(n, F.lit(1))
    dx, dy = b["mean_x"] - a["mean_x"], b["mean_y"] - a["mean_y"]
    weight = a["n"] * share
    both = {"n": n, "mean_x": a["mean_x"] + dx * share, "mean_y": a["mean_y"] + dy * share}
    both |= {"xx": a["xx"] + b["xx"] + dx * dx * weight, "yy": a["yy"] + b["yy"] + dy * dy * weight, "xy": a["xy"] + b["xy"] + dx * dy * weight}
    return F.struct(*[v.alias(name) for name, v in both.items()])


def merge_moments(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of moments per key; the rows of a key are few: one for each task, batch or state."""
    summed = ("n", "mean_x", "mean_y", "xx", "yy", "xy")
    zero = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(m) for m in summed[1:]])
    ends = [(F.min if m.startswith("low") else F.max)(m).alias(m) for m in MOMENTS if m not in summed]
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*summed))).alias("__rows"), *ends)
    both = held.withColumn("__all", F.aggregate("__rows", zero, _sum_of))
    return both.select(*keys, *[F.col(f"__all.{m}").alias(m) for m in summed], *[m for m in MOMENTS if m not in summed])


def correlation() -> Column:
    """Pearson's correlation from columns of moments; NULL if a side is flat."""
    varied = (F.col("low_x") < F.col("high_x")) & (F.col("low_y") < F.col("high_y"))
    return F.when(varied, F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")))

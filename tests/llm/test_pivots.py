"""Pivot search against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from gaugeboard.llm import pivots

FIELDS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
    + [T.StructField(n, T.LongType()) for n in ["row", "cell", "block", "vector", "distances", "score", "least", "rank", "kind"]]
)


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, *range(len(FIELDS) - 2)) for i, x in rows], FIELDS).repartition(4)


def brute(rows, keep=5, every=50):
    held = []
    for i, x in rows:
        if x is not None and all(v is not None and math.isfinite(v) for v in x):
            held.append((i, [max(-pivots.MOST, min(pivots.MOST, math.floor(256 * float(np.float32(v))))) for v in x]))
    out = []
    for a, (q, x) in enumerate(held):
        if q is None or q % every:
            continue
        scores = [(-sum(v * w for v, w in zip(x, y)), i is None, i) for b, (i, y) in enumerate(held) if a != b]
        best = sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:keep]
        out += [(q, rank, i, -score) for rank, (score, _, i) in enumerate(best, 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def clustered(seed, n=600, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, [float(v) for v in centres[rng.integers(6)] + rng.normal(scale=0.05, size=dim)]) for i in range(n)]


def nasty(seed=1):
    rows = clustered(seed, 220)
    rows += [(1000 + i, rows[50][1]) for i in range(150)]  # many copies of a query's vector
    rows += [(50, rows[7][1]), (50, rows[50][1]), (None, rows[0][1]), (None, None)]
    rows += [(2000, None), (2050, []), (2051, [None] * 8), (2100, [float("nan")] * 8), (2101, [1.0] * 7 + [float("inf")]), (2150, [0.25, -0.5]), (2151, [0.5] * 11)]
    return rows + [(2200, [1e30] + [0.0] * 7), (2201, [-3e38, 0.001] + [1.0] * 6), (-50, rows[3][1]), (2**62, rows[4][1])]


@pytest.mark.parametrize("block", [None, 16])
def test_search_of_nasty_vectors(spark, block):
    assert got(pivots.top_vectors(vectors(spark, nasty()), block=block)) == brute(nasty())


def test_few_first_candidates(spark, monkeypatch):
    monkeypatch.setattr(pivots, "FIRST", 6)
    monkeypatch.setattr(pivots, "TOGETHER", 3)
    rows = clustered(9)
    assert got(pivots.top_vectors(vectors(spark, rows), every=7, keep=4, pivots=5, block=64)) == brute(rows, 4, 7)


def test_few_vectors(spark):
    for rows in ([], [(0, None)], [(0, [1.0])], [(0, [1.0]), (1, [2.0]), (50, [-1.0])], [(1, [1.0]), (2, [1.0])]):
        assert got(pivots.top_vectors(vectors(spark, rows))) == brute(rows)


def placed(rows, count):
    x = pivots.whole_numbers(np.array([v for _, v in rows]))
    chosen = pivots.farthest_first(x, count)
    return x, pivots.distances(x, chosen).astype(np.float32)


def test_bounds_hold_and_eliminate(monkeypatch):
    rows = clustered(3, 2_000)
    x, away = placed(rows, 24)
    block = pivots.Block.__new__(pivots.Block)
    block.row, block.ids, block.missing = np.arange(len(x)), np.arange(len(x)), np.zeros(len(x), bool)
    block.x, block.away, block.square = x, away, (x.astype(float) ** 2).sum(1)
    bounds = pivots.upper_bounds(block.apart(away[:64]), block.square[:64], block.square, float(away.max()))
    exact = x[:64] @ x.T
    assert (bounds >= exact).all()
    least = np.sort(exact, axis=1)[:, -6]
    assert (bounds >= least[:, None]).mean() < 0.5  # over half of the candidates need no inner product
    found = list(block.search(x[:64], away[:64], np.arange(64), np.full(64, np.iinfo(np.int64).min), 5))
    for i, (scores, at) in enumerate(found):
        order = sorted((-exact[i, j], j) for j in range(len(x)) if j != i)[:5]
        assert list(zip((-scores).tolist(), at.tolist())) == order


def test_a_hot_cell_is_many_blocks(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(300)] + clustered(2, 60, 3)
    table = pivots.placed(vectors(spark, rows))
    cells = pivots.Cells(table, 32)
    assert max(cells.blocks) >= 9 and sum(cells.blocks) <= 9 + 60

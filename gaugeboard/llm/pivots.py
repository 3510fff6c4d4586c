"""Exact top-k by inner product, by elimination with a table of distances to pivots.

Vectors become integers (floor(256 x)); scores are integer inner products.  As |q - x|^2 = |q|^2 + |x|^2 - 2 q.x,
a lower bound of a distance is an upper bound of a score, and the triangle inequality gives one for every
pivot p: |d(q, p) - d(x, p)|.  The largest over all pivots counts.

* Pivots are chosen farthest first from the ``SAMPLE`` vectors of least hash; the distances of every vector to
  all of them are computed once and written beside it.
* A vector's cell is that of its nearest pivot; a cell is dealt by hash into blocks of about ``BLOCK`` vectors,
  so that a cell with most of the vectors, or many copies of one, is many tasks.
* Every query first searches one block of its own cell, for a threshold.  It is then sent to all other
  blocks of those cells whose range of distances leaves room for a score at the threshold.
* In a block the candidates of best bound are evaluated first; the others follow in the order of their bounds
  until the next bound is below the k-th best score.  Where an eighth of a block or more is left after the
  first ones, elimination has failed for that query and the block is evaluated as one matrix product.

Bounds are rounded up, and those equal to the threshold are kept, so that results are exact, ties included.
A task streams: it holds one block and some queries, never all of either.

Vectors that are NULL or hold NULL, NaN or infinite components take no part.  Shorter vectors count as
padded with zeros; integers beyond 2^26 count as 2^26.  Queries have an id that ``every`` divides; a row
without an id is a candidate, after all others of equal score.  Rows that repeat an id are rows of their own: each is a
candidate for the other, and each such query has its ranks.  Without vectors there is no row.  Further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gaugeboard.llm.texts import column
from gaugeboard.session import materialize

SCALE = 256
KEEP = 5
PIVOTS = 32
SAMPLE = 2_048
BLOCK = 16_384
#: Candidates evaluated before the others are looked at, and queries handled together.
FIRST = 128
TOGETHER = 64
MOST = 1 << 26
CANDIDATE, QUERY = 0, 1
PLACED = "vec_id long, vector array<int>, distances array<float>, cell int"
ROWS = "block int, kind int, row long, vec_id long, vector array<int>, distances array<float>, least long"
FOUND = "query_row long, query_id long, row long, vec_id long, score long"


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    read = vectors.select(column(vectors, "vec_id").cast("long").alias("vec_id"), column(vectors, "embedding").cast("array<double>").alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return read.where(F.col("x").isNotNull() & ~bad)


def _matrix(lists: pa.Array, kind=np.int64) -> np.ndarray:
    """Rows of equal length, padded with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if len(flat) == width * len(sizes):
        return flat.reshape(len(sizes), width).astype(kind)
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def whole_numbers(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * x), -MOST, MOST).astype(np.int64)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], pivots.shape[1])
    a, p = _wide(x, width).astype(np.float64), _wide(pivots, width).astype(np.float64)
    square = (a * a).sum(1)[:, None] + (p * p).sum(1) - 2 * (a @ p.T)
    return np.sqrt(np.maximum(square, 0))


def farthest_first(sample: np.ndarray, count: int) -> np.ndarray:
    """Distinct vectors of the sample, each the farthest from those before."""
    chosen = [0]
    near = distances(sample, sample[:1])[:, 0]
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _padded(vectors: list[list[float]]) -> np.ndarray:
    return whole_numbers(_matrix(pa.array(vectors, pa.list_(pa.float64())), np.float64))


def _lists(values: np.ndarray, kind: pa.DataType, sizes: np.ndarray | None = None) -> pa.ListArray:
    n, width = values.shape
    if sizes is not None and (sizes != width).any():
        flat, ends = values[np.arange(width) < sizes[:, None]], np.cumsum(sizes)
    else:
        flat, ends = values.ravel(), np.arange(1, n + 1) * width
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat).cast(kind))


def _place(pivots: np.ndarray):
    def rows(batches):
        for batch in batches:
            lists = batch.column(1)
            x = whole_numbers(_matrix(lists, np.float64))
            away = distances(x, pivots)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            cells = np.argmin(away, axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(x, pa.int32(), sizes), _lists(away.astype(np.float32), pa.float32()), pa.array(cells, pa.int32())],
                ["vec_id", "vector", "distances", "cell"],
            )

    return rows


def placed(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame | None:
    """Written table of the vectors: row, vec_id, vector, distances to the pivots, cell; None if there are none."""
    usable = _usable(vectors)
    few = usable.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(sample).select("x").collect()
    if not few:
        return None
    chosen = farthest_first(_padded([list(r["x"]) for r in few]), pivots)
    table = usable.mapInArrow(_place(chosen), PLACED)
    return materialize(table.select(F.monotonically_increasing_id().alias("row"), "*"), "pivot-table")


def _ranges(batches):
    """Per cell of a task: vectors, largest square norm, and the range of distances to every pivot."""
    seen: dict[int, list] = {}
    for batch in batches:
        x, away = _matrix(batch.column(0)), _matrix(batch.column(1), np.float64)
        cells = batch.column(2).to_numpy()
        square = (x.astype(np.float64) ** 2).sum(1)
        for cell in np.unique(cells).tolist():
            own = cells == cell
            n, most, low, high = seen.get(cell, (0, 0.0, np.inf, -np.inf))
            seen[cell] = (n + int(own.sum()), max(most, square[own].max()), np.minimum(low, away[own].min(0)), np.maximum(high, away[own].max(0)))
    for cell, (n, most, low, high) in seen.items():
        k = len(low)
        yield pa.RecordBatch.from_arrays(
            [pa.array([cell] * k, pa.int32()), pa.array(np.arange(k), pa.int32()), pa.array([n] * k, pa.int64()), pa.array([most] * k), pa.array(low), pa.array(high)],
            ["cell", "pivot", "n", "square", "low", "high"],
        )


class Cells:
    """What is known of the cells: as many rows as pivots, whatever the number of vectors."""

    def __init__(self, table: DataFrame, block: int):
        part = table.select("vector", "distances", "cell").mapInArrow(_ranges, "cell int, pivot int, n long, square double, low double, high double")
        whole = part.groupBy("cell", "pivot").agg(F.sum("n").alias("n"), F.max("square").alias("square"), F.min("low").alias("low"), F.max("high").alias("high"))
        rows = sorted(whole.collect(), key=lambda r: (r["cell"], r["pivot"]))
        self.cells = sorted({r["cell"] for r in rows})
        each = len(rows) // len(self.cells)
        self.square = np.array([r["square"] for r in rows[::each]])
        self.low, self.high = (np.array([r[c] for r in rows]).reshape(-1, each) for c in ("low", "high"))
        self.blocks = [-(-r["n"] // block) for r in rows[::each]]
        self.first = (np.cumsum(self.blocks) - self.blocks).tolist()

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(list(zip(self.cells, self.first, self.blocks)), "cell int, first int, blocks int")

    def open(self, x: np.ndarray, away: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which cells may hold a score of at least ``least`` for each query."""
        bound = np.zeros((len(x), len(self.cells)))
        for p in range(away.shape[1]):
            apart = np.maximum(self.low[:, p] - away[:, [p]], away[:, [p]] - self.high[:, p])
            np.maximum(bound, apart, out=bound)
        square = (x.astype(np.float64) ** 2).sum(1)
        return upper_bounds(bound, square, self.square, max(away.max(initial=0), self.high.max())) >= least[:, None]


def upper_bounds(apart: np.ndarray, q_square: np.ndarray, x_square: np.ndarray, farthest: float) -> np.ndarray:
    """Largest scores that lower bounds of distances leave; rounded up by more than distances in 32 bits can err."""
    slack = 1 + 1e-6 * (np.sqrt(q_square.max(initial=0)) + np.sqrt(x_square.max(initial=0))) * farthest
    return (q_square[:, None] + x_square - np.square(apart, dtype=np.float64)) / 2 + slack


def _open_cells(cells: Cells):
    def rows(batches):
        for batch in batches:
            x, away = _matrix(batch.column(3)), _matrix(batch.column(4), np.float64)
            least = batch.column(5).fill_null(np.iinfo(np.int64).min).to_numpy()
            at, cell = np.nonzero(cells.open(x, away, least))
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.array(cells.cells)[cell], pa.int32())], [*batch.schema.names, "cell"])

    return rows


class Block:
    """The candidates of one block."""

    def __init__(self, tables: list[pa.RecordBatch]):
        self.row, self.ids, self.missing = (np.concatenate([f(t) for t in tables]) for f in (_rows, _ids, _missing))
        parts = [_matrix(t.column("vector")) for t in tables]
        width = max(p.shape[1] for p in parts)
        self.x = np.concatenate([_wide(p, width) for p in parts])
        self.away = np.concatenate([_matrix(t.column("distances"), np.float32) for t in tables])
        self.square = (self.x.astype(np.float64) ** 2).sum(1)

    def apart(self, away: np.ndarray) -> np.ndarray:
        """Largest difference of distances to any pivot, for every query and candidate."""
        out = np.empty((len(away), len(self.row)), np.float32)
        mine = np.ascontiguousarray(self.away.T)
        for a in range(0, len(self.row), 2_048):
            best = np.zeros((len(away), len(self.row[a : a + 2_048])), np.float32)
            for p in range(len(mine)):
                apart = np.subtract.outer(away[:, p], mine[p, a : a + 2_048])
                np.maximum(best, np.abs(apart, out=apart), out=best)
            out[:, a : a + 2_048] = best
        return out

    def numbers(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and candidates in a type in which inner products are exact."""
        width = max(q.shape[1], self.x.shape[1])
        q, x = _wide(q, width), _wide(self.x, width)
        largest = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(width, 1)
        kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
        return q.astype(kind), x.astype(kind)

    def best(self, scores: np.ndarray, keep: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``keep`` best of the candidates ``at``, in order."""
        if len(at) > keep:
            some = scores >= np.partition(scores, -keep)[-keep]
            scores, at = scores[some], at[some]
        order = np.lexsort((self.row[at], self.ids[at], self.missing[at], -scores))[:keep]
        return scores[order], at[order]

    def search(self, q: np.ndarray, away: np.ndarray, own: np.ndarray, least: np.ndarray, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(scores, candidates) for each query: its best in this block, of at least its threshold."""
        square = (q.astype(np.float64) ** 2).sum(1)
        bounds = upper_bounds(self.apart(away), square, self.square, float(max(away.max(initial=0), self.away.max(initial=0))))
        place = np.minimum(np.searchsorted(self.row, own), len(self.row) - 1)
        itself = np.flatnonzero(self.row[place] == own)
        bounds[itself, place[itself]] = -np.inf
        n, (q, x) = len(self.row), self.numbers(q)
        k = min(FIRST, n)
        first = np.argpartition(-bounds, k - 1, axis=1)[:, :k]
        sure = np.einsum("qd,qkd->qk", q, x[first]).astype(np.int64)
        found = []
        for i in range(len(q)):
            ok = bounds[i, first[i]] >= least[i]
            found.append(self.best(sure[i, ok], keep, first[i, ok]))
            if len(found[i][0]) == keep:
                least[i] = max(least[i], found[i][0][-1])
        left = bounds >= least[:, None]
        np.put_along_axis(left, first, False, axis=1)
        many = np.flatnonzero(left.sum(1) > n // 8)
        whole = dict(zip(many.tolist(), (q[many] @ x.T).astype(np.int64)))
        for i in range(len(q)):
            at = np.flatnonzero(left[i])
            if i in whole:
                at = at[whole[i][at] >= least[i]]
                found[i] = self._merged(found[i], whole[i][at], at, keep)
            else:
                at = at[np.argsort(-bounds[i, at], kind="stable")]
                for start in range(0, len(at), FIRST):
                    part = at[start : start + FIRST]
                    if bounds[i, part[0]] < least[i]:
                        break
                    found[i] = self._merged(found[i], (x[part] @ q[i]).astype(np.int64), part, keep)
                    if len(found[i][0]) == keep:
                        least[i] = max(least[i], found[i][0][-1])
            scores, at = found[i]
            yield scores[scores >= least[i]], at[scores >= least[i]]

    def _merged(self, found, scores, at, keep):
        return self.best(np.concatenate([found[0], scores]), keep, np.concatenate([found[1], at]))


def _rows(t):
    return t.column("row").to_numpy(zero_copy_only=False)


def _ids(t):
    return t.column("vec_id").fill_null(0).to_numpy(zero_copy_only=False)


def _missing(t):
    return t.column("vec_id").is_null().to_numpy(zero_copy_only=False)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(block, kind, rows) in runs of equal block and kind."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("block").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            yield int(keys[a]) // 2, int(keys[a]) % 2, batch.slice(a, z - a)


def _searched(keep: int):
    def rows(batches):
        held, held_of, block = [], None, None
        for number, kind, part in _by_block(batches):
            if number != held_of:
                held, held_of, block = [], number, None
            if kind == CANDIDATE:
                held.append(part)
                continue
            if not held:
                continue
            block = block or Block(held)
            for start in range(0, part.num_rows, TOGETHER):
                some = part.slice(start, TOGETHER)
                least = some.column("least").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).copy()
                own = _rows(some)
                out = list(block.search(_matrix(some.column("vector")), _matrix(some.column("distances"), np.float32), own, least, keep))
                sizes = [len(s) for s, _ in out]
                scores, at = np.concatenate([s for s, _ in out]), np.concatenate([a for _, a in out])
                which = np.repeat(np.arange(len(out)), sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[which]), pa.array(_ids(some)[which]), pa.array(block.row[at]), pa.array(block.ids[at], mask=block.missing[at]), pa.array(scores)],
                    ["query_row", "query_id", "row", "vec_id", "score"],
                )

    return rows


def _best(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def top_vectors(vectors: DataFrame, every: int = 50, keep: int = KEEP, pivots: int = PIVOTS, block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id ``every`` divides, the ``keep`` others of largest inner product.

    All, if there are fewer; equal scores go by ascending vec_id.
    """
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score long"
    table = placed(vectors, pivots)
    if table is None:
        return spark.createDataFrame([], schema)
    cells = Cells(table, block or BLOCK)
    total = sum(cells.blocks)
    dealt = F.broadcast(cells.table(spark))  # a row for each pivot
    fields = ["block", "kind", "row", "vec_id", "vector", "distances", "least"]
    number = F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    rows = table.join(dealt, "cell").withColumns({"block": number, "least": F.lit(None).cast("long")})
    candidates = rows.withColumn("kind", F.lit(CANDIDATE)).select(fields)
    asking = rows.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("kind", F.lit(QUERY))

    def searched(queries: DataFrame) -> DataFrame:
        both = candidates.unionByName(queries.select(fields))
        return both.repartition(total, "block").sortWithinPartitions("block", "kind", "row").mapInArrow(_searched(keep), FOUND)

    near = materialize(_best(searched(asking), keep).drop("rank"), "near")
    known = _best(near, keep).where(F.col("rank") == keep).select(F.col("query_row").alias("row"), F.col("score").alias("known"))
    ready = asking.join(known, "row", "left").withColumn("least", F.col("known"))
    ready = ready.select("row", "vec_id", F.col("block").alias("home"), "vector", "distances", "least")
    sent = ready.mapInArrow(_open_cells(cells), "row long, vec_id long, home int, vector array<int>, distances array<float>, least long, cell int")
    sent = sent.join(dealt, "cell").withColumn("block", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)))
    far = searched(sent.where("block <> home").withColumn("kind", F.lit(QUERY)))
    out = _best(near.unionByName(far), keep)
    return out.select("query_id", "rank", "vec_id", "score")

"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are taken per text in Arrow batches.  Distinct fingerprints are linked at up to
``most`` differing bits: the 64 bits are cut into parts, part i gets a threshold t_i, and if the
t_i + 1 add up to more than ``most``, two linked fingerprints differ by at most t_i bits in some
part.  So it is enough to meet all fingerprints that agree with the probe in a part but for t_i bits.

* Bits that correlate, by counts over all fingerprints, share a part, so that parts differ in how
  well they tell fingerprints apart.
* For each number of parts a dynamic programme allots the thresholds (-1: part not used) for the
  least probes and expected candidates; the cheapest plan is taken.
* Fingerprints that share a probe are verified by their differing bits.  A bucket too large to
  compare pair by pair is cut again by its other bits, by the same principle, down to small ones.

Buckets give a spanning forest of their links, never all pairs: a group of n near copies costs
n - 1 edges per bucket.  Components of the edges are found by star contraction.

A text without words has fingerprint zero and is linked like any other; NULL is empty.  A NULL id
is no candidate for a component's least id, which is NULL only if all are.  Equal texts share one
fingerprint and are one node, however many.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from gaugeboard.llm.components import components
from gaugeboard.llm.texts import column, pieces, text_column, unpacked, whole_row
from gaugeboard.session import materialize

SHINGLE = 3
MOST = 2
SEED = 42
BITS = 64
#: Rows of a bucket compared pair by pair; larger ones are cut by further bits first.
PAIRWISE = 256
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """A 64-bit fingerprint of each text; bit b is set if over half of its shingles' hashes have it."""
    hashes, counts, digest = [], [], xxhash.xxh64_intdigest
    for text in texts:
        words = text.translate(_LOWER).split()
        joined = b" ".join(words)
        n = len(words) - shingle + 1
        if n <= 1:
            hashes += [digest(joined, SEED)] if words else []
            counts.append(int(bool(words)))
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = [0, *ends[: n - 1].tolist()]
        hashes += [digest(joined[a:z], SEED) for a, z in zip(begins, (ends[shingle - 1 :] - 1).tolist())]
        counts.append(n)
    values, sizes = np.array(hashes, np.uint64), np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    at, some = np.cumsum(sizes) - sizes, np.flatnonzero(sizes)
    if len(some):
        for bit in range(BITS):
            ones = np.add.reduceat(((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), at[some])
            out[some] |= (2 * ones > sizes[some]).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprint_rows(shingle: int):
    def rows(batches):
        for batch, texts in pieces(batches, limit=1_000_000):
            keep = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(fingerprints(texts, shingle).view(np.int64))], [*names, "bits"])

    return rows


def _bit_matrix(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _bit_counts(batches):
    """Per task, for every bit how often it and each other bit are set together, and the rows."""
    total, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        bits = _bit_matrix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.float32)
        total += bits.T @ bits
        n += len(bits)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(np.arange(BITS * BITS), -1), pa.int32()), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["cell", "n"]
    )


def bit_counts(nodes: DataFrame) -> tuple[np.ndarray, int]:
    rows = nodes.select("bits").mapInArrow(_bit_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(BITS * BITS), 0
    for row in rows:
        if row["cell"] < 0:
            n = row["n"]
        else:
            out[row["cell"]] = row["n"]
    return out.reshape(BITS, BITS), n


def correlation(together: np.ndarray, n: int) -> np.ndarray:
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(share * (1 - share))
    scale = np.outer(spread, spread)
    moved = together / max(n, 1) - np.outer(share, share)
    return np.abs(np.divide(moved, scale, out=np.zeros_like(moved), where=scale > 0))


def grouped_bits(related: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the bits into equal parts; each grows by the bit most correlated with it."""
    left, out = list(range(BITS)), []
    for p in range(parts):
        size = len(left) // (parts - p)
        part = [left.pop(int(np.argmax(related[np.ix_(left, left)].sum(axis=1))))]
        while len(part) < size:
            part.append(left.pop(int(np.argmax(related[np.ix_(part, left)].sum(axis=0)))))
        out.append(sorted(part))
    return out


def expected(differ: np.ndarray, most: int) -> np.ndarray:
    """Chance that two fingerprints differ by at most 0, 1, ... ``most`` of the bits that differ with these chances."""
    exact = np.zeros(most + 1)
    exact[0] = 1
    for q in differ:
        exact[1:] = exact[1:] * (1 - q) + exact[:-1] * q
        exact[0] *= 1 - q
    return np.cumsum(exact)


def probes(width: int, threshold: int) -> int:
    return sum(len(list(combinations(range(width), k))) for k in range(threshold + 1)) if threshold >= 0 else 0


def allotted(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 that add up to ``total`` with the least cost; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, chosen) in best.items():
            for t, more in enumerate(part, start=-1):
                if have + t not in step or cost + more < step[have + t][0]:
                    step[have + t] = (cost + more, [*chosen, t])
        best = step
    return best.get(total, (float("inf"), []))


def plan(together: np.ndarray, n: int, most: int = MOST) -> list[tuple[list[int], int]]:
    """Parts with their thresholds: the cheapest over the number of parts."""
    related = correlation(together, n)
    share = np.diag(together) / max(n, 1)
    differ = 2 * share * (1 - share)
    best, out = float("inf"), []
    for parts in range(1, most + 3):
        groups = grouped_bits(related, parts)
        costs = []
        for bits in groups:
            chance = expected(differ[bits], most)
            # A row built, dealt and sorted weighs about as much as eight comparisons.
            costs.append([0.0, *(8.0 * n * probes(len(bits), t) + n * n / 2 * chance[t] * (1 + t) for t in range(most + 1))])
        cost, chosen = allotted(costs, most - parts + 1)
        if cost < best:
            best, out = cost, [(b, t) for b, t in zip(groups, chosen) if t >= 0]
    return out


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _probe_rows(parts: list[tuple[list[int], int]]):
    masks = [[_mask(flip) for k in range(t + 1) for flip in combinations(bits, k)] for bits, t in parts]

    def rows(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for p, (bits, _) in enumerate(parts):
                own = values & np.uint64(_mask(bits))
                for flip in masks[p]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), p, np.int32)), pa.array((own ^ np.uint64(flip)).view(np.int64)), pa.array(values.view(np.int64))], ["part", "probe", "bits"]
                    )

    return rows


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j


def forest(values: np.ndarray, free: int, most: int = MOST) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between distinct fingerprints.

    ``free``: the bits in which they can differ.  Many rows are cut by three parts of those bits,
    one of which must agree in full between two that differ in at most ``most`` bits.
    """
    found, tree = [], _Forest(len(values))

    def compare(rows: np.ndarray) -> None:
        for i in range(len(rows) - 1):
            near = np.flatnonzero(np.bitwise_count(values[rows[i + 1 :]] ^ values[rows[i]]) <= most)
            for j in near.tolist():
                if tree.join(int(rows[i]), int(rows[i + 1 + j])):
                    found.append((int(rows[i]), int(rows[i + 1 + j])))

    def cut(rows: np.ndarray, bits: list[int]) -> None:
        if len(rows) <= PAIRWISE or len(bits) <= most + 1:
            return compare(rows)
        for p in range(most + 1):
            part = bits[p :: most + 1]
            keys = values[rows] & np.uint64(_mask(part))
            order = np.argsort(keys, kind="stable")
            edges = np.flatnonzero(np.diff(keys[order])) + 1
            rest = [b for b in bits if b not in part]
            for group in np.split(order, edges):
                if len(group) > 1:
                    cut(rows[group], rest)

    cut(np.arange(len(values)), [b for b in range(BITS) if free >> b & 1])
    return found


def _edges(most: int):
    def edges(batches):
        """Edges from rows sorted by (part, probe); a bucket may span batches."""
        held, key, out = [], None, []

        def close():
            values = np.unique(np.concatenate(held))
            if len(values) > 1:
                if len(values) == 2:
                    near = bool(np.bitwise_count(values[0] ^ values[1]) <= most)
                    return [(values[0], values[1])] if near else []
                free = int(np.bitwise_or.reduce(values ^ values[0]))
                return [(values[i], values[j]) for i, j in forest(values, free, most)]
            return []

        for batch in batches:
            part, probe, bits = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            bits = bits.view(np.uint64)
            new = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (probe[1:] != probe[:-1])))
            alone = np.diff(np.append(new, len(bits))) == 1
            for k, (a, z) in enumerate(zip(new.tolist(), [*new[1:].tolist(), len(bits)])):
                here = (part[a], probe[a])
                if here != key:
                    if len(held) > 1 or held and len(held[0]) > 1:
                        out += close()
                    held, key = [], here
                    if alone[k] and z < len(bits):
                        continue
                held.append(bits[a:z])
            if len(out) > 10_000:
                yield _edge_rows(out)
                out = []
        if held:
            out += close()
        yield _edge_rows(out)

    return edges


def _edge_rows(found: list) -> pa.RecordBatch:
    ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, 0])), pa.array(np.ascontiguousarray(ends[:, 1]))], ["u", "v"])


def links(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """(u, v): edges that connect all fingerprints within ``most`` bits; ``nodes``: distinct ``bits``."""
    parts = plan(*bit_counts(nodes), most)
    rows = nodes.select("bits").mapInArrow(_probe_rows(parts), "part int, probe long, bits long")
    dealt = rows.repartition(F.col("part"), F.col("probe")).sortWithinPartitions("part", "probe")
    return dealt.mapInArrow(_edges(most), "u long, v long")


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple:
    """A row by its id and the hash of id and text; the first part is its id as text."""
    doc_id = column(docs, id_col).cast("string")
    return F.coalesce(doc_id, F.lit("")), F.xxhash64(doc_id, text_column(docs, text_col))


def fingerprinted(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, ``hash`` of the row and ``bits`` of every row, written once."""
    doc_id = column(docs, id_col)
    doc_id = doc_id if id_col in docs.columns else doc_id.cast("long")
    plain = docs.select(doc_id.alias("doc_id"), _row_key(docs, id_col, text_col)[1].alias("hash"), text_column(docs, text_col).alias("text"))
    schema = T.StructType([plain.schema["doc_id"], T.StructField("hash", T.LongType()), T.StructField("bits", T.LongType())])
    return materialize(plain.mapInArrow(_fingerprint_rows(shingle), schema), "fingerprints")


def groups(prints: DataFrame, most: int = MOST) -> DataFrame:
    """(bits, component_id, keeper) of every distinct fingerprint: the least id of its component, and the row that stands for it."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash"))
    nodes = materialize(prints.groupBy("bits").agg(first.alias("first")), "nodes")
    found = components(links(nodes, most)).select(F.col("node").alias("bits"), "component")
    named = nodes.join(found, "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    least = named.groupBy("component").agg(F.min("first").alias("keeper"))
    return named.select("bits", "component").join(least, "component").select("bits", F.col("keeper.doc_id").alias("component_id"), "keeper")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per row."""
    prints = fingerprinted(docs, id_col, text_col, shingle)
    found = prints.join(groups(prints, most), "bits")
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE, most: int = MOST) -> DataFrame:
    """One row of each component: that of the least id, and of several with that id one of least hash."""
    found = groups(fingerprinted(docs, id_col, text_col, shingle), most)
    keepers = found.select(F.coalesce(F.col("keeper.doc_id").cast("string"), F.lit("")).alias("id"), F.col("keeper.hash").alias("hash")).distinct()
    doc_id, key = _row_key(docs, id_col, text_col)
    rows = docs.select(whole_row(docs).alias("row"), doc_id.alias("id"), key.alias("hash"))
    kept = rows.join(materialize(keepers, "kept"), ["id", "hash"], "left_semi").groupBy("id", "hash").agg(F.first("row").alias("row"))
    return kept.select(*unpacked(kept, "row", docs.columns))

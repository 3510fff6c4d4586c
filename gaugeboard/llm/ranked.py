"""Ranked lexical search by MaxScore with bounds on pairs of terms.

The documents are tokenised once into an index: a written table with one row per document that has a term
(doc_id, n, and the codes and counts of its query terms).  It is cut by documents, not by terms, so no
posting list is ever shuffled or held whole, and a term that stands in every document is no hot key.
Document frequencies are summed per task before they are shuffled.

A task walks its rows of the index in shards of ``SHARD`` documents.  For each shard it inverts the rows,
takes every term's largest impact and, for each pair of terms that stand side by side in a query's plan
(terms by rising weight), intersects their lists and stores the joint maximum.  Query terms t1, t2, ... then
have the bounds B(0) = 0, B(i) = min(B(i-1) + max(i), B(i-2) + joint(i-1, i)): a document with none but
the first i terms can't score more, whichever of them it has, and terms that seldom meet add up to
little more than the larger of the two.  Only documents with a term beyond the last i of B(i) < threshold are
looked at; the other terms are added from the heaviest down, and a document is left as soon as its
sum and the bound of the rest stay below the threshold.  The threshold is the score of the task's k-th
best so far, and at first that of a bounded sample of the index (``WARM``).  Scores equal to it are kept
until document ids decide, so results are exact.

The queries are read in blocks of ``BLOCK_BYTES`` of text, each block a pass of its own; what is broadcast
(a block's terms, plans and weights) is bounded by that.  A document's shard holds 64-bit integers only.

Terms are runs of ASCII letters, digits and bytes from 0x80 on, A-Z lower-cased.  A NULL text has no
term; documents without a term count nowhere.  A NULL doc_id comes after all others of equal score.  Rows that repeat an id or a
whole document, and queries that repeat an item_id, are rows of their own.  Queries without a match have
no row; empty tables give none.  Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gaugeboard.llm.texts import PIECE_BYTES, column, pieces, text_column
from gaugeboard.session import materialize

#: Text of queries that is handled, and broadcast, at a time.
BLOCK_BYTES = 4_000_000
#: Documents of a shard, and documents scored first for a threshold to begin with.
SHARD = 4_096
WARM = 2_048
INDEX = "doc_id long, n long, codes array<int>, counts array<int>"
HITS = "query int, item_id long, doc_id long, score long"
_TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _runs(text: bytes) -> Iterator[list[bytes]]:
    """The terms in lists of bounded length."""
    if len(text) <= PIECE_BYTES:
        yield terms(text)
        return
    text = text.translate(_TERMS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _index_rows(vocabulary):
    def rows(batches):
        code = {t: i for i, t in enumerate(vocabulary.value)}
        for batch, texts in pieces(batches):
            sizes, found = np.zeros(len(texts), np.int64), []
            for at, text in enumerate(texts):
                for run in _runs(text):
                    sizes[at] += len(run)
                    codes = np.fromiter(map(code.get, run, repeat(-1)), np.int64, len(run))
                    found.append(codes[codes >= 0] + at * len(code))
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            doc, codes = np.divmod(keys, max(len(code), 1))
            offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (codes, counts)]
            out = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes), *lists], ["doc_id", "n", "codes", "counts"])
            yield out.filter(pa.array(sizes > 0))

    return rows


def index(docs: DataFrame, vocabulary) -> DataFrame:
    """A row for each document with a term; ``vocabulary`` is a broadcast list of query terms."""
    read = docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), text_column(docs, "text").alias("text"))
    return materialize(read.mapInArrow(_index_rows(vocabulary), INDEX), "index")


def _frequencies(size: int):
    def rows(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["code", "df"])

    return rows


@dataclass
class Plan:
    """What a task needs to score: weights by code, and each query's terms by rising weight with its pairs."""

    documents: int
    length: int
    weights: np.ndarray
    items: list
    queries: list[list[int]]
    pairs: list[tuple[int, int]]
    joints: list[list[int]]
    threshold: list[int]
    keep: int

    @classmethod
    def of(cls, documents: int, length: int, df: np.ndarray, items: list, queries: list[list[int]], keep: int) -> Plan:
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        ordered = [sorted((c for c in q if df[c]), key=lambda c: (weights[c], c)) for q in queries]
        number: dict[tuple[int, int], int] = {}
        joints = [[number.setdefault((min(a, b), max(a, b)), len(number)) for a, b in zip(q, q[1:])] for q in ordered]
        return cls(documents, length, weights, items, ordered, list(number), joints, [1] * len(items), keep)


class Shard:
    """The inverted rows of some documents, with the largest impacts of terms and pairs."""

    def __init__(self, plan: Plan, n: np.ndarray, lengths: np.ndarray, codes: np.ndarray, counts: np.ndarray):
        doc = np.repeat(np.arange(len(n)), lengths)
        share = 90 * plan.documents
        wide = n.astype(object) if int(n.max(initial=0)) * share >= 1 << 62 else n
        m = (10 + wide * share // plan.length).astype(np.int64)
        tf = counts.astype(np.int64)
        impact = plan.weights[codes] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        order = np.argsort(codes, kind="stable")
        self.size, self.doc, self.impact = len(n), doc[order], impact[order]
        self.at = np.searchsorted(codes[order], np.arange(len(plan.weights) + 1)).tolist()
        self.most = [0] * len(plan.weights)
        present = np.flatnonzero(np.diff(self.at))
        if len(present):
            best = np.maximum.reduceat(self.impact, np.array(self.at)[present])
            for code, value in zip(present.tolist(), best.tolist()):
                self.most[code] = value
        self.joint = self._joints(plan.pairs)

    def postings(self, code: int) -> tuple[np.ndarray, np.ndarray]:
        a, z = self.at[code], self.at[code + 1]
        return self.doc[a:z], self.impact[a:z]

    def _joints(self, pairs: list[tuple[int, int]]) -> list[int]:
        """Largest impact of both terms of each pair together, or of one alone."""
        row, first, out = np.zeros(self.size, np.int64), None, []
        for a, b in pairs:
            most = max(self.most[a], self.most[b])
            if self.most[a] and self.most[b]:
                docs, impact = self.postings(a)
                if a != first:
                    if first is not None:
                        row[self.postings(first)[0]] = 0
                    row[docs], first = impact, a
                others, theirs = self.postings(b)
                here = row[others]
                most = max(most, int(np.where(here > 0, here + theirs, 0).max()))
            out.append(most)
        return out

    def bounds(self, query: list[int], joints: list[int]) -> list[int]:
        out = [0]
        for i, code in enumerate(query):
            bound = out[i] + self.most[code]
            if i:
                bound = min(bound, out[i - 1] + self.joint[joints[i - 1]])
            out.append(bound)
        return out

    def search(self, query: list[int], joints: list[int], threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of at least ``threshold``, all of them."""
        none = np.zeros(0, np.int64)
        bounds = self.bounds(query, joints)
        if bounds[-1] < threshold:
            return none, none
        p = next(i for i in range(len(query), -1, -1) if bounds[i] < threshold)
        lists = [self.postings(c) for c in query[p:]]
        docs, impacts = np.concatenate([x for x, _ in lists]), np.concatenate([x for _, x in lists])
        docs, place = np.unique(docs, return_inverse=True)
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, place, impacts)
        for i in range(p, -1, -1):
            keep = sums + bounds[i] >= threshold
            if not keep.all():
                docs, sums = docs[keep], sums[keep]
            if not i or not len(docs):
                break
            others, theirs = self.postings(query[i - 1])
            if len(others):
                found = np.minimum(np.searchsorted(others, docs), len(others) - 1)
                sums = sums + np.where(others[found] == docs, theirs[found], 0)
        return docs, sums


def _best(scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` best: score falling, id rising, missing ids last."""
    some = np.arange(len(scores))
    if len(some) > keep:
        some = np.flatnonzero(scores >= np.partition(scores, -keep)[-keep])
    return some[np.lexsort((ids[some], missing[some], -scores[some]))[:keep]]


def _searched(plan):
    def rows(batches):
        p: Plan = plan.value
        nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        top = [nothing] * len(p.items)
        threshold = list(p.threshold)
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD):
                part = batch.slice(start, SHARD)
                named = part.column(0)
                ids, missing = named.fill_null(0).to_numpy(zero_copy_only=False), named.is_null().to_numpy(zero_copy_only=False)
                codes, counts = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
                shard = Shard(p, part.column(1).to_numpy(), part.column(2).value_lengths().to_numpy(zero_copy_only=False), codes, counts)
                for i, query in enumerate(p.queries):
                    docs, scores = shard.search(query, p.joints[i], threshold[i])
                    if not len(docs):
                        continue
                    merged = [np.concatenate(x) for x in zip(top[i], (scores, ids[docs], missing[docs]))]
                    best = _best(*merged, p.keep)
                    top[i] = tuple(x[best] for x in merged)
                    if len(best) == p.keep:
                        threshold[i] = max(threshold[i], int(top[i][0][-1]))
        for i, (scores, ids, missing) in enumerate(top):
            if len(scores):
                same = [pa.array([x] * len(scores), kind) for x, kind in ((i, pa.int32()), (p.items[i], pa.int64()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(ids, mask=missing), pa.array(scores)], ["query", "item_id", "doc_id", "score"])

    return rows


def _ranked(hits: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, text) of the queries, some ``BLOCK_BYTES`` at a time."""
    read = queries.select(column(queries, "item_id").cast("long").alias("item_id"), F.coalesce(text_column(queries, "text"), F.lit("")).alias("text"))
    held, size = [], 0
    for row in read.toLocalIterator(prefetchPartitions=False):
        text = row["text"].encode("utf-8", "surrogatepass")
        if held and size + len(text) > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((row["item_id"], text))
        size += len(text)
    if held:
        yield held


def _block_hits(docs: DataFrame, block: list[tuple], keep: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    found = [(item, set(terms(text))) for item, text in block]
    vocabulary = sorted(set().union(*[t for _, t in found]))
    code = {t: i for i, t in enumerate(vocabulary)}
    shared = context.broadcast(vocabulary)
    table = index(docs, shared)
    n, length = table.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    per_task = table.select("codes").mapInArrow(_frequencies(len(vocabulary)), "code int, df long")
    for row in per_task.groupBy("code").agg(F.sum("df").alias("df")).collect():
        df[row["code"]] = row["df"]
    plan = Plan.of(n, length or 1, df, [item for item, _ in found], [[code[t] for t in held] for _, held in found], keep)
    warm = context.broadcast(plan)
    sample = table.orderBy(F.xxhash64("doc_id", "n")).limit(WARM)
    kept = _ranked(sample.mapInArrow(_searched(warm), HITS), keep).where(F.col("rank") == keep).select("query", "score").collect()
    for row in kept:
        plan.threshold[row["query"]] = row["score"]
    ready = context.broadcast(plan)
    hits = materialize(_ranked(table.mapInArrow(_searched(ready), HITS), keep), "hits")
    for sent in (shared, warm, ready):
        sent.unpersist()
    return hits.select("item_id", "rank", "doc_id", "score")


def top_documents(docs: DataFrame, queries: DataFrame, keep: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``keep`` best documents of each query with a score above 0.

    Equal scores go by ascending doc_id.  A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a
    document's m is 10 + 90 n N div L, its score the sum of weight ((10^9 tf) div (1000 tf + 8 m)) over the
    query's distinct terms; N documents with a term hold L terms, this one n.
    """
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(queries):
        out = out.unionByName(_block_hits(docs, block, keep))
    return out

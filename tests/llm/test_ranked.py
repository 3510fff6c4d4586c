"""Ranked search against a plain sum over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from nasty import EXTRA, documents, rows as nasty_rows
from pyspark.sql import types as T

from gaugeboard.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())] + [T.StructField(n, T.LongType()) for n in EXTRA + ["query", "rank", "codes"]])


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, keep=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // length
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        best = sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:keep]
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(best, 1)]
    return sorted(out, key=repr)


def items(spark, found):
    return spark.createDataFrame([(*r, *range(len(ITEMS) - 2)) for r in found], ITEMS)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def queries():
    rng = random.Random(2)
    out = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 40)))) for i in range(25)]
    out += [(30, None), (31, ""), (32, "!!! ..."), (33, "ABC def-GHI jkl"), (34, "absent words"), (35, "same same"), (36, "ÄÖ ü"), (37, "x" * 50_000)]
    return out + [(None, "w1 w2 w3"), (5, "w7 w8 w9"), (5, "w7 w8 w9"), (38, "w1 " * 5_000), (39, "b c B_c [c]")]


def test_search_of_nasty_documents(spark):
    docs = [(i, t) for i, t, _ in nasty_rows()]
    assert got(ranked.top_documents(documents(spark), items(spark, queries()))) == brute(docs, queries())


def test_small_shards_blocks_and_runs(spark, monkeypatch):
    for name, value in (("SHARD", 16), ("BLOCK_BYTES", 3_000), ("WARM", 12), ("PIECE_BYTES", 64)):
        monkeypatch.setattr(ranked, name, value)
    docs = [(i, t) for i, t, _ in nasty_rows(4)]
    assert got(ranked.top_documents(documents(spark, nasty_rows(4)), items(spark, queries()), 3)) == brute(docs, queries(), 3)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert got(ranked.top_documents(documents(spark, []), items(spark, queries()))) == []
    assert got(ranked.top_documents(documents(spark), none)) == []
    assert got(ranked.top_documents(documents(spark, [(1, None, "a"), (2, " .", "a")]), items(spark, queries()))) == []


def test_ties_go_by_id(spark):
    docs = [(i, "apple pear", "s") for i in range(40, 0, -1)] + [(None, "apple pear", "s")]
    found = got(ranked.top_documents(documents(spark, docs), items(spark, [(1, "pear")])))
    assert [r[2] for r in sorted(found, key=lambda r: r[1])] == list(range(1, 11))


@pytest.mark.parametrize("seed", range(6))
def test_bounds_hold_and_pairs_tighten_them(seed):
    rng = np.random.default_rng(seed)
    size, docs = 30, 80
    parts = [np.unique(rng.integers(0, size, rng.integers(1, 12))) for _ in range(docs)]
    codes, counts = np.concatenate(parts), rng.integers(1, 5, sum(map(len, parts)))
    n = np.array([len(p) for p in parts]) + rng.integers(0, 40, docs)
    query = rng.permutation(size)[:14].tolist()
    plan = ranked.Plan.of(docs, int(n.sum()), np.bincount(codes, minlength=size), [0], [query], 10)
    shard = ranked.Shard(plan, n, np.array([len(p) for p in parts]), codes, counts)
    ordered, joints = plan.queries[0], plan.joints[0]
    bounds, plain = shard.bounds(ordered, joints), np.cumsum([0] + [shard.most[c] for c in ordered])
    doc = np.repeat(np.arange(docs), [len(p) for p in parts])
    m = 10 + 90 * n * docs // int(n.sum())
    impact = plan.weights[codes] * (10**9 * counts // (1000 * counts + 8 * m[doc]))
    for i in range(len(ordered) + 1):
        sums = np.zeros(docs, np.int64)
        inside = np.isin(codes, ordered[:i])
        np.add.at(sums, doc[inside], impact[inside])
        assert sums.max() <= bounds[i] <= plain[i]
    assert bounds[-1] < plain[-1]
    for threshold in (1, int(np.median(sums)), int(sums.max()), int(sums.max()) + 1):
        found, scores = shard.search(ordered, joints, threshold)
        want = np.flatnonzero(sums >= threshold)
        assert found.tolist() == want.tolist() and scores.tolist() == sums[want].tolist()

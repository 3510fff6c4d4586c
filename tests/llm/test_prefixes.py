"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from gaugeboard.llm import prefixes

FIELDS = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ["key", "comp", "depth", "position", "weight", "size", "digest", "length", "n_convs"]]
)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, *range(len(FIELDS) - 4)) for r in rows], FIELDS).repartition(5)


def turns_of(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [t[2:] for t in sorted(turns)] for conv, turns in own.items()}


def respliced(own):
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        head = c - int(np.fmod(c, 5))
        out[c] = own.get(head, [])[:h] + own[c][h:]
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        children[node[:-1]] += bool(node)
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (min(of), len(node), min(members[node[:-1]]) if node else None, len(of), children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(c for c in of if len(convs[c]) == len(node)))).encode()).hexdigest())
        for node, of in members.items()
    )


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def nasty(seed=3):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice("abc")) for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(100 + c, t, "user", f"same {t}") for c in range(40) for t in range(12)]  # copies of one conversation
    rows += [(200, t, "user", f"{t % 3} é") for t in range(300)]  # a long one, and one that follows it for a while
    rows += [(201, t, "user", f"{t % 3} é") for t in range(250)] + [(201, 250, "user", "x" * 20_000)]
    rows += [(300, None, None, None), (300, None, "user", "first"), (300, 1, "user", ""), (301, 1, "", ""), (301, 1, "", "")]
    rows += [(302, 5, "b", "tie"), (302, 5, "a", "tie"), (302, 5, "a", "tie"), (None, 1, "user", "lost"), (-7, 0, "user", "a"), (-5, 0, "user", "b"), (-5, 1, "user", "c")]
    rows += [(303, 1, "ab", "c"), (304, 1, "a", "bc"), (305, 1, "assistant", "a\nb"), (2**62, 1, "user", "a")]
    return rows


@pytest.mark.parametrize("small", [3, 40, None])
def test_trie_of_nasty_conversations(spark, small):
    rows = nasty()
    assert rows_of(prefixes.prefix_trie(conversations(spark, rows), small)) == brute_trie(turns_of(rows))


def test_respliced_conversations(spark):
    rows = nasty(5)
    assert rows_of(prefixes.respliced_trie(conversations(spark, rows))) == brute_trie(respliced(turns_of(rows)))


def test_a_conversation_cut_over_tasks(spark, monkeypatch):
    from gaugeboard.operators import ordered

    monkeypatch.setattr(ordered, "LARGE_GROUP", 50)
    monkeypatch.setattr(prefixes, "CHUNK", 7)
    rows = nasty(8)
    assert rows_of(prefixes.respliced_trie(conversations(spark, rows))) == brute_trie(respliced(turns_of(rows)))


def test_no_conversations(spark):
    assert rows_of(prefixes.respliced_trie(conversations(spark, []))) == []
    assert rows_of(prefixes.prefix_trie(conversations(spark, [(None, 1, "user", "a")]))) == []


def test_rows_without_turns_or_roles_columns(spark):
    bare = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "conv_id long, text string")
    want = brute_trie({1: [("", "a")], 2: [("", "a"), ("", "b")]})
    assert rows_of(prefixes.prefix_trie(bare)) == want


@pytest.mark.parametrize("shape", ["random", "path", "star"])
def test_decomposition_of_a_forest(shape):
    rng = np.random.default_rng(4)
    n = 400
    parent = np.array([-1 if i % 97 == 0 else {"random": int(rng.integers(max(0, i - 30), i)), "path": i - 1, "star": i - i % 97}[shape] for i in range(n)])
    depth, top = np.zeros(n, np.int64), np.arange(n)
    for i in range(n):
        if parent[i] >= 0:
            depth[i], top[i] = depth[parent[i]] + 1, top[parent[i]]
    values = rng.integers(-5, 50, (2, n))
    weight = rng.integers(1, 9, n)
    sums = values.copy()
    for i in reversed(range(n)):
        if parent[i] >= 0:
            sums[:, parent[i]] += sums[:, i]
            weight[parent[i]] += weight[i]
    assert (prefixes.decompose(top, parent, depth, weight, values) == sums).all()

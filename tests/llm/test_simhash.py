import random

import numpy as np
import pytest
import xxhash

import nasty
from gaugeboard.llm import simhash
from gaugeboard.llm.components import components


def fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = nasty.words(lower)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(values, most=2):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_near_duplicates(spark):
    rows = nasty.rows()
    prints = [fingerprint(t) for _, t, _ in rows]
    label = grouped(prints)
    want = []
    for (i, _, _), p, g in zip(rows, prints, label):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == g and rows[j][0] is not None]
        want.append((i, f"{p:016x}", min(ids, default=None)))
    docs = nasty.documents(spark, rows)
    assert nasty.by_row(simhash.near_duplicates(docs)) == sorted(want, key=repr)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    found = kept.collect()
    assert sorted(grouped([fingerprint(r["text"]) for r in found])) == list(range(len(found)))
    assert {r["doc_id"] for r in found} == {c for _, _, c in want}


def test_empty_table(spark):
    docs = nasty.documents(spark, [])
    assert simhash.near_duplicates(docs).count() == 0 and simhash.without_near_duplicates(docs).count() == 0
    [row] = simhash.near_duplicates(nasty.documents(spark, [(None, None, None)])).collect()
    assert tuple(row) == (None, "0" * 16, None)


def dense(n, flips, seed=3):
    """Fingerprints around few centres, as near copies have."""
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        value = rng.choice([0, (1 << 64) - 1, 0x123456789ABCDEF0])
        for _ in range(rng.randint(0, flips)):
            value ^= 1 << rng.randrange(64)
        out.add(value)
    return sorted(out)


@pytest.mark.parametrize("flips", [1, 3, 6])
def test_links_connect_what_is_near(spark, flips):
    values = dense(900, flips)
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "bits long")
    edges = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in simhash.links(nodes).collect()]
    assert all((u ^ v).bit_count() <= 2 for u, v in edges)
    place = {v: i for i, v in enumerate(values)}
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in edges:
        a, b = root(place[u]), root(place[v])
        parent[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(values))] == grouped(values)


def test_forest_of_a_large_bucket():
    values = np.array(dense(3000, 4), np.uint64)
    edges = simhash.forest(values, (1 << 64) - 1)
    assert len(edges) == len(values) - len(set(grouped(values.tolist())))


@pytest.mark.parametrize("most", [1, 2, 3])
def test_plans_meet_the_pigeonhole_bound(most):
    rng = np.random.default_rng(2)
    bits = (rng.random((2000, 64)) < rng.random(64)).astype(float)
    bits[:, 10] = bits[:, 40]
    for n in (2_000, 10**9):
        parts = simhash.plan(bits.T @ bits * (n / 2000), n, most)
        assert sum(t + 1 for _, t in parts) > most
        used = [b for part, _ in parts for b in part]
        assert len(used) == len(set(used))
    related = simhash.correlation(bits.T @ bits, 2000)
    assert any({10, 40} <= set(part) for part in simhash.grouped_bits(related, 3))


def test_allotment_is_the_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(20):
        costs = [[0.0, *np.cumsum(rng.random(3)).tolist()] for _ in range(4)]
        best = min(
            sum(c[t + 1] for c, t in zip(costs, ts)) for ts in np.ndindex(4, 4, 4, 4) for ts in [tuple(x - 1 for x in ts)] if sum(ts) == -1
        )
        cost, chosen = simhash.allotted(costs, -1)
        assert cost == pytest.approx(best) and sum(chosen) == -1


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 4999), (7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(200)}, 5000: 4999, 4999: 4999}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0

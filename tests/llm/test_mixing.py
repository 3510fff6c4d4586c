from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import nasty
from gaugeboard.llm import mixing


def water_filled(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] <= rest * weight[s] / total}
        if not full:
            target |= {s: rest * weight[s] / total for s in open_}
            break
        target |= {s: most * sizes[s] for s in full}
        rest -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def test_targets_and_takes(spark):
    found = mixing.mixture(nasty.documents(spark)).collect()
    sizes = defaultdict(int)
    for _, text, source in nasty.rows():
        sizes[source] += len(nasty.words(text))
    want = water_filled(sizes)
    sources = Counter((i, len(nasty.words(t)), sizes[s]) for i, t, s in nasty.rows())
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in found) == sources
    assert {round(r["target"], 6) for r in found} == {round(t, 6) for t in want.values()}
    for r in found:
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(rate) <= r["copies"] <= int(rate) + 1 and r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]


def test_reruns_agree_and_the_mix_has_the_copies(spark):
    docs = nasty.documents(spark)
    first = nasty.by_row(mixing.mixture(docs))
    assert first == nasty.by_row(mixing.mixture(docs.repartition(3)))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.schema == docs.schema
    copies = Counter()
    for r in mixing.mixture(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +copies


def test_fractions_are_kept_on_average(spark):
    rows = [(i, "a b c d", "big" if i % 10 else "small") for i in range(4000)]
    found = mixing.mixture(nasty.documents(spark, rows)).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    for r in found.collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.06)


def test_empty_table_and_no_words(spark):
    assert mixing.mixture(nasty.documents(spark, [])).count() == 0
    assert mixing.mix(nasty.documents(spark, [])).count() == 0
    found = mixing.mixture(nasty.documents(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert {(r["size"], r["target"], r["copies"]) for r in found} == {(0, 0.0, 0)}


def test_plan_is_native(spark):
    plan = mixing.mix(nasty.documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

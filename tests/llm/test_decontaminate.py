import hashlib
import re

import numpy as np
import pytest

import nasty
from gaugeboard.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item or "")
    for i, text, _ in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        names = ",".join(sorted(found))
        yield i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


ITEMS = [
    ("a", " ".join(nasty.words(nasty.rows()[0][1])[20:60])), ("b", " ".join(nasty.words(nasty.rows()[3][1])[5:25]).upper()), ("b", "a\tB!c"),
    ("c", None), ("d", " ... "), (None, "JKL"), ("e", "not in any document at all"), ("f", " ".join(nasty.words(nasty.rows()[0][1])[30:50])), ("a", "ÄÖ"),
]


@pytest.mark.parametrize("block", [4_000_000, 150])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_BYTES", block)
    rows = nasty.rows() + [(95, "x " * 500 + ITEMS[0][1] + " y" * 400, "s"), (96, "a-b-c", "s"), (97, ITEMS[0][1] + " " + ITEMS[0][1], "s")]
    docs, bench = nasty.documents(spark, rows), spark.createDataFrame(ITEMS, "item_id string, text string")
    want = sorted(brute(rows, ITEMS), key=repr)
    assert nasty.by_row(d.contamination(docs, bench)) == want
    kept = d.without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((w[0] for w in want if not w[5]), key=repr)


def test_many_blocks_are_one_evaluation(spark, monkeypatch):
    rows = nasty.rows()
    items = [(f"i{i}", " ".join(nasty.words(rows[i % 12][1])[i : i + 20])) for i in range(60)]
    docs, bench = nasty.documents(spark, rows), spark.createDataFrame(items, "item_id string, text string").coalesce(1)
    sizes = []
    real = d._search
    monkeypatch.setattr(d, "_search", lambda block: sizes.append(len(block.value.by_length)) or real(block))
    monkeypatch.setattr(d, "BLOCK_BYTES", sum(len(t) for _, t in items) // 50)
    found = d.hits(docs.select("doc_id", "text"), bench)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("MapInArrow") == 1 and len(sizes) >= 40
    monkeypatch.setattr(d, "_search", real)
    assert nasty.by_row(d.contamination(docs, bench)) == sorted(brute(rows, items), key=repr)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert d.contamination(nasty.documents(spark, []), bench).count() == 0
    got = d.contamination(nasty.documents(spark), bench).collect()
    assert len(got) == len(nasty.rows()) and not any(r["n_hit"] or r["contaminated"] for r in got)


def test_index_counts_and_locates():
    rng = np.random.default_rng(4)
    for size, alphabet in ((1, 1), (2, 1), (50, 2), (400, 3), (1000, 60)):
        text = rng.integers(1, alphabet + 1, size)
        index = d.FMIndex(text, sample=5)
        order = d.suffix_array(np.append(text, 0)).tolist()
        assert order == sorted(range(size + 1), key=lambda i: [*text[i:].tolist(), 0])
        for n in (1, 2, 4):
            phrases = rng.integers(1, alphabet + 2, (30, n))
            which, rows = index.search(phrases)
            found = {int(p): sorted(index.locate(np.arange(a, z)).tolist()) for p, (a, z) in zip(which, rows)}
            for p, phrase in enumerate(phrases.tolist()):
                places = [i for i in range(size - n + 1) if text[i : i + n].tolist() == phrase]
                assert found.get(p, []) == places

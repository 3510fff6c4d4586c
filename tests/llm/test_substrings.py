import hashlib

import pytest

import nasty
from gaugeboard.llm import substrings

N = substrings.LENGTH


def brute(rows):
    """Per row: words, and the positions covered by windows that start in a document of smaller id."""
    least = {}
    for i, t, _ in rows:
        w = nasty.words(t)
        for a in range(len(w) - N + 1) if i is not None else ():
            key = tuple(w[a : a + N])
            least[key] = min(i, least.get(key, i))
    for i, t, _ in rows:
        w, gone = nasty.words(t), set()
        for a in range(len(w) - N + 1) if i is not None else ():
            if least[tuple(w[a : a + N])] < i:
                gone |= set(range(a, a + N))
        yield i, w, gone


def test_digests(spark):
    rows = nasty.rows()
    want = sorted(((i, len(w), len(g), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in g).encode()).hexdigest()) for i, w, g in brute(rows)), key=repr)
    got = nasty.by_row(substrings.digests(nasty.documents(spark, rows)))
    assert got == want
    assert sum(r[2] for r in got) > 1000


def test_kept_texts_and_other_columns(spark):
    rows = nasty.rows()
    docs = nasty.documents(spark, rows)
    out = substrings.without_duplicates(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = sorted(((r["doc_id"], nasty.words(r["text"])) for r in out.collect()), key=repr)
    assert got == sorted(((i, [x for k, x in enumerate(w) if k not in g]) for i, w, g in brute(rows)), key=repr)
    untouched = {i: t for (i, t, _), (_, _, g) in zip(rows, brute(rows)) if not g and i not in (None, 73)}
    assert {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] in untouched} == untouched
    cut = [r for r in out.collect() if r["doc_id"] in range(51, 56)]
    assert cut and all(r["n_chars"] == len(r["text"]) for r in cut)


def test_spans_are_copies_of_their_references(spark):
    rows = nasty.rows()
    text = {i: nasty.words(t) for i, t, _ in rows if i != 73}
    found = substrings.spans(nasty.documents(spark, rows)).collect()
    assert found
    for s in found:
        assert s["reference"] < s["doc_id"] and s["last"] - s["first"] >= N
        span, reference = text[s["doc_id"]][s["first"] : s["last"]], text[s["reference"]]
        windows = {tuple(reference[a : a + N]) for a in range(len(reference) - N + 1)}
        assert all(tuple(span[a : a + N]) in windows for a in range(len(span) - N + 1))


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(2, "a " * 13, "s"), (1, "a " * 14, "s")], [(None, "a " * 20, "s"), (5, "a " * 20, "s")]])
def test_small_tables(spark, rows):
    got = nasty.by_row(substrings.digests(nasty.documents(spark, rows)))
    assert [r[:3] for r in got] == sorted(((i, len(w), len(g)) for i, w, g in brute(rows)), key=repr)

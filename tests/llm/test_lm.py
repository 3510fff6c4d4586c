import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import nasty
from gaugeboard.llm import lm, ppm, queries


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def trie(texts, order):
    counts = defaultdict(Counter)
    for text in texts:
        raw = b"\xff" * order + text + b"\xff"
        for i in range(order, len(raw)):
            for k in range(order + 1):
                counts[raw[i - k : i]][raw[i]] += 1
    return counts


def chance(counts, context, symbol):
    """Straight from the definition: escape from order to order, excluding what was seen."""
    p, excluded = 1.0, set()
    for k in range(len(context), -1, -1):
        seen = counts.get(context[len(context) - k :])
        if not seen:
            continue
        left = {s: n for s, n in seen.items() if s not in excluded}
        scale = sum(left.values()) + len(left)
        if symbol in left:
            return p * left[symbol] / scale
        if left:
            p *= len(left) / scale
        excluded |= set(seen)
    return p / (256 - len(excluded))


@pytest.mark.parametrize("order", [2, 3, 5])
def test_code_lengths_follow_the_definition(order):
    train, test = [b"abracadabra", b"", "né à nez".encode(), b"abra"], [b"abrac", b"zzz", b"", b"cad\xc3"]
    counts = trie(train, order)
    keys, at = np.unique(ppm.grams(train + test, order)[0], return_inverse=True)
    trained, n = np.unique(ppm.grams(train, order)[0], return_counts=True)
    number = np.zeros(len(keys), np.int64)
    number[np.searchsorted(keys, trained)] = n
    pairs = np.zeros((256, 256), np.int64)
    np.add.at(pairs.reshape(-1), ppm.grams(train, 1)[0].astype(int), 1)
    costs = ppm.code_lengths(keys, number, pairs, order)
    for key, cost in zip(keys.tolist(), costs):
        raw = key.to_bytes(order + 1, "big")
        assert cost == pytest.approx(math.log10(chance(counts, raw[:-1], raw[-1])), abs=1e-9)
    # Every context's symbols add up to one.
    everything = np.arange(256, dtype=np.uint64) | np.uint64(int.from_bytes(b"abrac"[:order], "big") << 8)
    keys2 = np.unique(np.concatenate([keys, everything]))
    number2 = np.zeros(len(keys2), np.int64)
    number2[np.searchsorted(keys2, trained)] = n
    costs = ppm.code_lengths(keys2, number2, pairs, order)
    assert (10 ** costs[np.searchsorted(keys2, everything)]).sum() == pytest.approx(1)


def test_scores_of_nasty_documents(spark):
    rows = [(i, t if t is None else t[:3000], s) for i, t, s in nasty.rows()]
    got = lm.scores(nasty.documents(spark, rows), order=3).collect()
    train = [(t or "").encode() for i, t, _ in rows if not held(i)]
    tokens = Counter(w for t in train for w in t.split())
    tokens[None] = len(train)
    n, v = sum(tokens.values()), len(tokens)
    counts, want = trie(train, 3), []
    for i, t, _ in rows:
        raw = b"\xff" * 3 + (t or "").encode() + b"\xff"
        score = sum(math.log10(chance(counts, raw[j - 3 : j], raw[j])) for j in range(3, len(raw)))
        mine = [*(t or "").encode().split(), None]
        base = sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in mine)
        want.append((i, held(i), len(mine), sum(tokens[w] > 0 for w in mine), n, base, score))
    key = lambda r: (repr(r[0]), r[2], round(r[6], 2))
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5:] == (pytest.approx(b[5], rel=1e-6), pytest.approx(b[6], rel=1e-4, abs=1e-4))


def test_the_query_counts_words_in_lower_case(spark):
    """Only A-Z: letters beyond ASCII keep their case, and other separators stay inside words."""
    texts = ["The THE the", "tHE Cat\u00a0Sat", "\u00c4B \u00e4b \u00c4b", "K k \u212a", None, "", "the\x0bEND\x1cend", "ZEBRA zebra [@`{"]
    rows = [(i, texts[i % len(texts)], None) for i in range(64)]
    got = {r["doc_id"]: r for r in queries.lm_score(nasty.documents(spark, rows)).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    mine = {i: [*nasty.words((t or "").translate(low)), None] for i, t, _ in rows}
    tokens = Counter(w for i in mine if not held(i) for w in mine[i])
    n, v = sum(tokens.values()), len(tokens)
    for i, ws in mine.items():
        base = sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in ws)
        assert tuple(got[i])[1:6] == (held(i), len(ws), sum(tokens[w] > 0 for w in ws), n, pytest.approx(base, rel=1e-9))


def test_nothing_to_learn_and_empty_table(spark):
    assert lm.scores(nasty.documents(spark, [])).count() == 0
    only = next(i for i in range(100) if held(i))
    [row] = lm.scores(nasty.documents(spark, [(only, "ab", None)])).collect()
    assert row["train_tokens"] == 0 and row["base_score"] == 0 and row["score"] == pytest.approx(-3 * math.log10(256))


def test_lookup_finds_every_key():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 10_000).astype(np.uint64))
    table = lm.Lookup(keys, np.arange(len(keys)))
    assert (table(keys[::-1]) == np.arange(len(keys))[::-1]).all()

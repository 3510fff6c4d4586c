from collections import Counter

import nasty
from gaugeboard.llm import rules


def covered(words, n, later):
    seen, marks = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)), set()
    before = set()
    for i in range(len(words) - n + 1):
        gram = tuple(words[i : i + n])
        if gram in before if later else seen[gram] > 1:
            marks |= set(range(i, i + n))
        before.add(gram)
    return marks


def brute(text):
    words = nasty.words(text)
    chars, seen, lines, size = sum(map(len, words)), set(), 0, 0
    for line in (text or "").split("\n"):
        if nasty.words(line):
            lines += line in seen
            size += sum(map(len, nasty.words(line))) if line in seen else 0
            seen.add(line)
    again = len(covered(words, 5, False))
    failed = len(words) < 10 or 100 * again > 20 * len(words)
    poor = size > rules.LINE_SHARE * chars or any(
        sum(len(words[i]) for i in covered(words, n, True)) > share * chars for n, share in rules.DUPLICATE_SHARES.items()
    )
    return len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), lines, again, failed, not failed and not poor


def test_against_brute_force(spark):
    rows = nasty.rows() + [(90, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2, None), (91, "# $x " + nasty.rows()[0][1] + "\nl i\nl i", None)]
    got = nasty.by_row(rules.rated(nasty.documents(spark, rows)))
    assert got == sorted(((i, *brute(t)) for i, t, _ in rows), key=repr)


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(rules, "mixed", lambda x: x * 0)
    texts = [b"a b c d e a b c d e f g h i j k", b"a b c d e", b"", b"q w e r t y u i o p q w e r t"]
    found = rules.facts(texts)
    assert found["n_repeat_words"].tolist() == [brute(t.decode())[4] for t in texts]
    assert found["kept"].tolist() == [brute(t.decode())[6] for t in texts]


def test_empty_table(spark):
    assert rules.rated(nasty.documents(spark, [])).count() == 0

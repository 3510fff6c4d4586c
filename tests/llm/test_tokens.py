import random

import nasty
from gaugeboard.llm import tokens

PIECES = ["a", "b", " ", "  ", "\n", "'", "s", "re", "1", "23", "é", "!", "$", "the ", "Th", "ou", " "]


def tokenizer():
    with open(tokens.RANKS, "rb") as file:
        return tokens.Tokenizer(file.read())


def edited(text, edits):
    chosen, reach = [], 0
    for a, z, new in sorted(edits):
        if reach <= a <= z <= len(text):
            chosen.append((a, z, new))
            reach = max(z, a + 1)
    for a, z, new in reversed(chosen):
        text = text[:a] + new + text[z:]
    return text, len(chosen)


def test_edits_give_the_counts_of_the_new_text():
    rng, tok, encoded, whole = random.Random(1), tokenizer(), 0, 0
    for k in range(600):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 900 if k % 3 == 0 else 40)))
        tree = tokens.TokenTree.of(tok, text)
        assert tree.total == len(tok.encoding.encode_ordinary(text))
        tree = tokens.TokenTree.unpacked(tok, text, tree.packed())
        edits = []
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(0, len(text) + 1)
            edits.append((a, a + rng.choice([0, 1, 2, 5, 100]), "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6)))))
        n = tree.apply(edits)
        want, number = edited(text, edits)
        assert (tree.text(), n, tree.total) == (want, number, len(tok.encoding.encode_ordinary(want)))
        encoded, whole = encoded + tree.encoded, whole + len(tok.pieces(want))
    assert encoded < whole / 4


def test_counts_and_stored_trees(spark):
    tok = tokenizer()
    rows = nasty.rows() + [(98, "mail a.b@c.org or 12345 and 123", "s"), (99, "1234", None)]
    docs, want = nasty.documents(spark, rows), []
    for i, t, _ in rows:
        new, n = edited(t or "", tokens.redactions(t or ""))
        want.append((i, len(tok.pieces(t or "")), len(tok.encoding.encode_ordinary(t or "")), n, len(tok.encoding.encode_ordinary(new))))
    got = [(*r[:4], r[5]) for r in nasty.by_row(tokens.counts(docs))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    edits = spark.createDataFrame([(98, 0, 4, "post"), (98, 2, 3, "overlaps"), (98, 90, 91, "outside"), (99, 4, 4, "5"), (99, None, 1, None), (1234, 0, 0, "x")], "doc_id long, start int, end int, text string")
    after = {r["doc_id"]: r for r in tokens.recounted(tokens.trees(docs), edits).filter("doc_id > 90").collect()}
    assert after[98]["n_edits"] == 1 and after[98]["n_tokens_after"] == len(tok.encoding.encode_ordinary("post a.b@c.org or 12345 and 123"))
    assert after[99]["n_edits"] == 1 and after[99]["n_tokens_after"] == len(tok.encoding.encode_ordinary("12345"))


def test_empty_table(spark):
    assert tokens.counts(nasty.documents(spark, [])).count() == 0

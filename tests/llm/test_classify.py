import random
import zlib

import numpy as np
import pyarrow as pa

import nasty
from gaugeboard.llm import classify


def labelled(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = nasty.prose(rng, rng.randint(20, 80))
        if not good:
            w = text.split()
            text = " ".join(x + "***" for x in w) if i % 8 else " ".join(x for x in w[:8] for _ in range(8))
        rows.append((i, text, "s"))
        labels.append((i, int(good)))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_and_stability(spark):
    rows, labels = labelled(400)
    docs = nasty.documents(spark, rows + nasty.rows()[:3] + [(900, None, None), (901, "", "s"), (None, "x y", None)])
    table = spark.createDataFrame([*labels, (5000, 1), (None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    found = classify.scores(docs, table).collect()
    assert len(found) == 406
    truth = dict(labels)
    checked = [r for r in found if r["held_out"] and r["doc_id"] in truth and r["doc_id"] > 20]
    assert checked and all(r["held_out"] == held(r["doc_id"]) for r in found if r["doc_id"] is not None)
    right = np.mean([r["predicted"] == truth[r["doc_id"]] for r in checked])
    assert right > 0.97, right
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    empty = {r["score"] for r in found if r["doc_id"] in (900, 901)}
    assert len(empty) == 1
    again = classify.scores(docs.repartition(2), table).collect()
    assert sorted((repr(r["doc_id"]), r["score"]) for r in found) == sorted((repr(r["doc_id"]), r["score"]) for r in again)
    kept = classify.accepted(docs, table)
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(r["doc_id"]) for r in found if r["predicted"])


def test_held_out_labels_are_not_learned(spark):
    rows, labels = labelled(120)
    wrong = [(i, 1 - y if held(i) else y) for i, y in labels]
    docs = nasty.documents(spark, rows)
    a, b = (classify.fitted(docs, spark.createDataFrame(t, "doc_id long, quality int")) for t in (labels, wrong))
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_one_class_or_nothing(spark):
    docs = nasty.documents(spark, [(1, "a b", None), (3, "c", None)])
    none = classify.scores(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r["score"] for r in none} == {0.5}
    ones = classify.scores(docs, spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")).collect()
    assert all(r["score"] > 0.99 for r in ones)
    assert classify.scores(nasty.documents(spark, []), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_training_takes_the_same_rows_and_bounded_text(spark, monkeypatch):
    """Too many rows and too much text for the sample: what is taken does not hang on the order of the rows."""
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat(concat('w', id % 7, IF(id % 3 = 0, ' good ', ' bad ')), CAST(5 + id % 20 AS INT)) AS text")
    docs = docs.unionByName(docs.where("doc_id % 5 = 0"))  # ids that repeat
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 3 = 0 AS INT) AS quality")
    for name, value in (("TRAIN_BYTES", 9_000), ("LEAST_STEPS", 20)):
        monkeypatch.setattr(classify, name, value)
    found = [classify.fitted(docs.repartition(n), labels.repartition(n), sample=60) for n in (1, 3, 7)]
    assert all((w == found[0][0]).all() and b == found[0][1] for w, b in found)
    seen = []
    real = classify.train
    monkeypatch.setattr(classify, "train", lambda texts, labels: seen.append((len(texts), sum(map(len, texts)))) or real(texts, labels))
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 4_000] * 5 + ["y"], "label": [0, 1, 0, 1, 0, 1]})
    list(classify._train(iter([batch])))
    assert seen == [(2, 8_000)]

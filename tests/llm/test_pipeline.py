import random

import corpus_pipeline
import nasty
from test_classify import labelled
from test_decontaminate import brute


def test_stages_take_effect_and_leave_clean_documents(spark, tmp_path):
    rng = random.Random(3)
    rows, labels = labelled(240)
    passage, item = nasty.prose(rng, 60, 3000), nasty.prose(rng, 40, 3000)
    good = [(1000 + i, nasty.prose(rng, 150, 3000), f"src{i % 3}") for i in range(30)]
    copies = [(2000 + i, good[i % 3][1], "src0") for i in range(9)]
    repeats = [(3000 + i, nasty.prose(rng, 90, 3000) + " " + passage + " " + nasty.prose(rng, 80, 3000), "src1") for i in range(4)]
    leaked = [(4000 + i, nasty.prose(rng, 60, 3000) + " " + item + " " + nasty.prose(rng, 50, 3000), "src2") for i in range(3)]
    docs = nasty.documents(spark, rows + good + copies + repeats + leaked + [(None, good[5][1] + " more", None), (5000, None, "src1")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
        path = f"{tmp_path}/{len(kept)}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == docs.columns
        kept.append({r["doc_id"]: r["text"] for r in out.collect()})
    quality, near, parts, clean, mixed = kept
    truth = dict(labels)
    assert sum(i in quality for i, y in truth.items() if not y) <= 6 and sum(i not in quality for i, y in truth.items() if y) <= 6
    assert {i for i, _, _ in good + repeats + leaked} <= set(quality)
    assert not {i for i, _, _ in copies} & set(near) and {i for i, _, _ in good} <= set(near)
    joined = " ".join(nasty.words(passage))
    assert [joined in " ".join(nasty.words(parts[3000 + i])) for i in range(4)] == [True, False, False, False]
    assert {i: t for i, t in parts.items() if i in near and 1000 <= (i or 0) < 1030} == {i: t for i, t, _ in good}
    judged = {r[0]: r[5] for r in brute([(i, t, None) for i, t in parts.items()], [("i", item)])}
    assert set(clean) == {i for i in parts if not judged[i]} and 4000 not in clean
    assert not any(" ".join(nasty.words(item)) in " ".join(nasty.words(t)) for t in clean.values())
    assert set(mixed) <= set(clean)
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in rows.collect()} == set(mixed)

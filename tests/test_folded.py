"""Logs that are folded now and then: bounded reads, repeats, crashes."""

import pytest
from pyspark.sql import functions as F, types as T

from gaugeboard.operators.collections import apply_changes, compact_changes
from gaugeboard.sources.folders import Folder
from gaugeboard.streaming.folded import FoldedLog

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])


def summed(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def batch(spark, i):
    return spark.sql(f"SELECT * FROM VALUES ({i % 7}L, {i}L), (3L, 1L) AS t(k, n)").coalesce(1)


def state(log):
    return sorted(tuple(r) for r in summed(log.read()).collect())


def want(n):
    out = {}
    for i in range(n):
        for k, v in ((i % 7, i), (3, 1)):
            out[k] = out.get(k, 0) + v
    return sorted(out.items())


def test_a_hundred_batches_read_few_folders(spark, tmp_path):
    log = FoldedLog(spark, str(tmp_path / "log"), SCHEMA, summed, every=10)
    assert log.read().count() == 0 and log.folded_to() == -1
    for i in range(100):
        log.append(batch(spark, i), i)
        assert len(log.folders()) <= 11
    kept = sum(len(Folder(spark, str(tmp_path / "log" / part)).names()) for part in ("log", "base", "current"))
    assert kept <= 2 * 10 + 4
    assert state(log) == want(100)


def test_repeated_batches_count_once(spark, tmp_path):
    log = FoldedLog(spark, str(tmp_path / "log"), SCHEMA, summed, every=3)
    for i in (0, 1, 1, 2, 2, 1, 3, 3):
        log.append(batch(spark, i), i)
    assert state(log) == want(4)


def test_a_crash_between_fold_and_marker_changes_nothing(spark, tmp_path, monkeypatch):
    log = FoldedLog(spark, str(tmp_path / "log"), SCHEMA, summed, every=3)
    for i in range(4):
        log.append(batch(spark, i), i)

    def crash(self, name):
        raise OSError("gone")

    log.append(batch(spark, 4), 4)
    with monkeypatch.context() as patched:
        patched.setattr(Folder, "mark", crash)
        with pytest.raises(OSError):
            log.append(batch(spark, 5), 5)
        assert log.folded_to() == 2 and state(log) == want(6)
    again = FoldedLog(spark, str(tmp_path / "log"), SCHEMA, summed, every=3)
    again.append(batch(spark, 5), 5)  # the stream repeats its last batch
    assert again.folded_to() == 5 and state(again) == want(6)


def test_a_crash_before_old_folders_are_gone(spark, tmp_path, monkeypatch):
    log = FoldedLog(spark, str(tmp_path / "log"), SCHEMA, summed, every=2)

    def crash(self, name):
        raise OSError("gone")

    for i in range(3):
        log.append(batch(spark, i), i)
    with monkeypatch.context() as patched:
        patched.setattr(Folder, "delete", crash)
        with pytest.raises(OSError):
            log.append(batch(spark, 3), 3)
    assert state(log) == want(4)
    for i in range(4, 8):
        log.append(batch(spark, i), i)
    assert state(log) == want(8)


def test_a_half_written_batch_is_not_read(spark, tmp_path):
    log = FoldedLog(spark, str(tmp_path / "log"), SCHEMA, summed, every=5)
    log.append(batch(spark, 0), 0)
    half = tmp_path / "log" / "log" / f"{1:019d}"
    batch(spark, 1).write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    assert state(log) == want(1)


def test_a_table_read_before_the_last_fold_can_still_be_computed(spark, tmp_path):
    log = FoldedLog(spark, str(tmp_path / "log"), SCHEMA, summed, every=4)
    for i in range(6):
        log.append(batch(spark, i), i)
    early = log.read()
    for i in (6, 7):
        log.append(batch(spark, i), i)
    assert sorted(tuple(r) for r in summed(early).collect()) == want(6)


def test_folded_changes_are_the_changes(spark, tmp_path):
    rows = [(k, s, op, v) for s, (k, op, v) in enumerate([(i % 5, ("create", "update", "delete", "update")[i * i % 4 if i % 9 else 2], i) for i in range(60)])]
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("v", T.LongType())])
    whole = spark.createDataFrame(rows, schema)
    log = FoldedLog(spark, str(tmp_path / "log"), schema, lambda d: compact_changes(d, "k", "seq", "op", ["v"]), every=3)
    for i in range(0, 60, 6):
        log.append(spark.createDataFrame(rows[i : i + 6], schema).coalesce(1), i)
    found = apply_changes(log.read(), "k", "seq", "op", ["v"])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, apply_changes(whole, "k", "seq", "op", ["v"]).collect()))

"""Streams over several micro-batches, with replays, restarts and late closing rows."""

import datetime as dt
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeboard.streaming import counters, flows
from test_catalog import LOG, LOG_SCHEMA, STATE

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def arrivals(spark, tmp_path):
    """A function that adds one Parquet file to a directory, and the directory."""
    folder = tmp_path / "in"

    def add(rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))

    return add, str(folder)


POSTS = "id int, ts timestamp, n int"


def _made(folder):
    Path(folder).mkdir(parents=True, exist_ok=True)
    return folder


def _post(i, minutes, n=1):
    return (i, T0 + dt.timedelta(minutes=minutes), n)


def test_dedup_across_batches_and_restart(spark, arrivals, tmp_path):
    add, folder = arrivals
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")

    def drained():
        stream = flows.dedup(flows.read_files(spark, folder, POSTS, files_per_batch=1), "id", "ts", "1 hour")
        return sorted(r["id"] for r in flows.drain(stream, "t", sink, checkpoint).collect())

    add([_post(1, 0), _post(2, 1), _post(1, 0)], POSTS)
    add([_post(2, 1), _post(3, 2)], POSTS)
    assert drained() == [1, 2, 3]
    add([_post(3, 2), _post(4, 3)], POSTS)
    assert drained() == [1, 2, 3, 4]
    assert drained() == [1, 2, 3, 4]


def test_counts_keep_the_newest_batch(spark, arrivals):
    add, folder = arrivals
    add([_post(1, 0), _post(2, 0), _post(1, 1)], POSTS)
    add([_post(1, 2)], POSTS)
    counts = flows.running_counts(flows.read_files(spark, folder, POSTS, files_per_batch=1), ["id"])
    got = flows.drain_updates(counts, ["id"], "counts")
    assert sorted((r["id"], r["n"]) for r in got.collect()) == [(1, 3), (2, 1)]


def test_a_log_goes_with_its_checkpoint(spark, arrivals, tmp_path):
    add, folder = arrivals
    sink, checkpoint = str(tmp_path / "log"), str(tmp_path / "ck")

    def counted(at):
        counts = flows.running_counts(flows.read_files(spark, folder, POSTS, files_per_batch=1), ["id"])
        return sorted((r["id"], r["n"]) for r in flows.drain_updates(counts, ["id"], "counts", sink, at, every=2).collect())

    for i in range(3):
        add([_post(i % 2, 0)], POSTS)
    assert counted(checkpoint) == [(0, 2), (1, 1)]
    add([_post(1, 1)], POSTS)
    assert counted(checkpoint) == [(0, 2), (1, 2)] == counted(checkpoint)
    with pytest.raises(ValueError):
        counted(str(tmp_path / "other"))


def test_windows_close_with_the_watermark(spark, arrivals):
    add, folder = arrivals
    add([_post(1, 0), _post(2, 4), _post(3, 7)], POSTS)
    aggs = [F.count(F.lit(1)).alias("n")]
    windows = lambda: flows.drain(
        flows.tumbling(flows.read_files(spark, folder, POSTS, files_per_batch=1), "ts", "0 minutes", "5 minutes", [], aggs), "w"
    )
    assert [r["n"] for r in windows().collect()] == [2]
    add([_post(9, 60)], POSTS)
    assert sorted(r["n"] for r in windows().collect()) == [1, 2]


def test_sessions(spark, arrivals):
    add, folder = arrivals
    add([_post(1, 0), _post(1, 3), _post(1, 20), _post(2, 1), _post(3, 300)], POSTS)
    stream = flows.sessions(flows.read_files(spark, folder, POSTS), "ts", "0 minutes", "5 minutes", ["id"], [F.sum("n").alias("n")])
    assert sorted((r["id"], r["n"]) for r in flows.drain(stream, "s").collect()) == [(1, 1), (1, 2), (2, 1)]


@pytest.mark.parametrize("size", [3, 14])
def test_changes_in_batches(spark, arrivals, size):
    add, folder = arrivals
    for i in range(0, len(LOG), size):
        add(LOG[i : i + size], LOG_SCHEMA)
    stream = flows.read_files(spark, folder, LOG_SCHEMA, files_per_batch=1)
    got = flows.drain_changes(stream, "k", "seq", "op", ["name", "n"])
    assert sorted(tuple(r) for r in got.collect()) == STATE


def test_anomalies_against_history(spark, arrivals):
    add, folder = arrivals
    history = spark.createDataFrame([("a", float(i % 3)) for i in range(30)] + [("b", 100.0), ("b", 102.0)], "k string, v double")
    add([("a", 50.0), ("a", 1.0), ("b", 101.0), ("c", 1e9)], "k string, v double")
    found = flows.anomalies(flows.read_files(spark, folder, "k string, v double"), "k", "v", history, 3.0)
    assert [(r["k"], r["v"]) for r in flows.drain(found, "a").collect()] == [("a", 50.0)]


def test_profiles_add_up(spark, arrivals):
    add, folder = arrivals
    add([_post(1, 0, 5), _post(2, 0, 7)], POSTS)
    add([_post(3, 0, 12)], POSTS)
    got = flows.drain_profiles(flows.read_files(spark, folder, POSTS, files_per_batch=1)).summary()
    row = got.where("`column` = 'n'").first()
    assert (row["n"], row["mean"], row["min"], row["max"], row["min_text"], row["median"]) == (3, 8.0, 5.0, 12.0, None, 7.0)
    assert row["std"] == pytest.approx(13**0.5)


def test_profiles_of_texts_and_missing_values(spark, arrivals):
    add, folder = arrivals
    schema = "t string, v double, `odd.name` long"
    add([("b", None, None), (None, None, 3)], schema)
    add([("a", 2.0, None), ("c", float("nan"), None), ("b", None, None)], schema)
    profile = flows.drain_profiles(flows.read_files(spark, folder, schema, files_per_batch=1))
    got = {r["column"]: r for r in profile.summary().collect()}
    assert tuple(got["t"]) == ("t", 4, None, None, None, None, None, "a", "c")
    assert tuple(got["v"]) == ("v", 1, 2.0, None, 2.0, 2.0, 2.0, None, None)
    assert got["odd.name"]["n"] == 1
    assert [tuple(r) for r in profile.categories(2).collect()] == [("t", "b", 2), ("t", "a", 1)]
    assert {tuple(r) for r in profile.correlations().collect() if r["col_a"] == "v"} <= {("v", "v", None), ("v", "odd.name", None)}


def test_profiles_of_many_batches_equal_those_of_all_rows(spark, arrivals):
    """Folded several times; far from zero, with gaps, in uneven batches."""
    add, folder = arrivals
    rng = np.random.default_rng(6)
    schema, rows = "a double, b double, c double, word string", []
    for size in (1, 400, 3, 900, 50, 2):
        a = rng.normal(size=size) + len(rows) / 100
        b = 1e8 + a * 3 + rng.normal(size=size)
        batch = [(float(x), float(y) if x > -1 else None, float(z), f"w{int(abs(x) * 4)}") for x, y, z in zip(a, b, rng.normal(size=size) ** 3)]
        add(batch, schema)
        rows += batch
    profile = flows.drain_profiles(flows.read_files(spark, folder, schema, files_per_batch=1), every=2)
    frame = pd.DataFrame(rows, columns=["a", "b", "c", "word"])
    got = profile.summary().toPandas().set_index("column")
    for c in "abc":
        assert (got.loc[c, "n"], got.loc[c, "min"], got.loc[c, "max"]) == (frame[c].count(), frame[c].min(), frame[c].max())
        assert got.loc[c, "mean"] == pytest.approx(frame[c].mean(), rel=1e-12) and got.loc[c, "std"] == pytest.approx(frame[c].std(), rel=1e-7)
        place = (frame[c].dropna() <= got.loc[c, "median"]).mean()
        assert abs(place - 0.5) <= flows.profiles.MEDIAN_BOUND + 1 / frame[c].count()
    corr = {(r["col_a"], r["col_b"]): r["corr"] for r in profile.correlations().collect()}
    assert len(corr) == 9 and all(corr[x, y] == pytest.approx(frame[x].corr(frame[y]), abs=1e-7) for x, y in corr)
    want = sorted(frame["word"].value_counts().items(), key=lambda kv: (-kv[1], kv[0]))[:10]
    assert sorted(((r["category"], r["count"]) for r in profile.categories().collect()), key=lambda kv: (-kv[1], kv[0])) == want


REACTIONS = "user int, ts timestamp, v double"


def test_counters_follow_posts_with_late_reactions(spark, tmp_path):
    posts, reactions = str(tmp_path / "posts"), str(tmp_path / "reactions")

    def add(path, schema, rows):
        spark.createDataFrame([(*r[:1], T0 + dt.timedelta(minutes=r[1]), *r[2:]) for r in rows], schema).coalesce(1).write.mode("append").parquet(path)

    schema = "id int, ts timestamp, user int"
    add(posts, schema, [(1, 0, 7), (2, 5, 8), (3, 6, None)])
    add(reactions, REACTIONS, [(7, 1, 1.0), (9, 2, 5.0)])
    add(posts, schema, [(4, 30, 7)])
    add(reactions, REACTIONS, [(7, 9, 2.0), (7, 11, 4.0), (8, 4, 1.0), (None, 6, 1.0), (7, 30, 8.0), (7, 40, None)])  # late ones come with the second batch
    left, close_left = flows.closable(flows.read_files(spark, posts, schema, files_per_batch=1), "ts", user=-1)
    right, close_right = flows.closable(flows.read_files(spark, reactions, REACTIONS, files_per_batch=1), "ts", user=-1)
    counted = counters.post_counters(left, right, "id", "ts", "user", "10 MINUTES", "1 hour", {"total": F.col("v")})
    got = flows.drain_windows(counted, lambda: (close_left(), close_right()), "posts")
    assert sorted((r["id"], r["n"], r["total"]) for r in got.collect()) == [(1, 2, 3.0), (2, 0, None), (3, 0, None), (4, 2, 8.0)]


def _counted(stream):
    return counters.ending_counters(stream, "key", "ts", "v", "10 minutes", "0 minutes")


def test_counters_end_once(spark, arrivals):
    add, folder = arrivals
    schema = "key int, ts timestamp, v double"
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    add([(1, at(0), 1.0), (1, at(5), 2.0), (1, at(30), 4.0), (2, at(31), None)], schema)  # a pause inside a batch
    add([(1, at(36), 8.0), (None, at(37), 1.0)], schema)
    add([(2, at(60), 16.0)], schema)
    stream, close = flows.closable(flows.read_files(spark, folder, schema, files_per_batch=1), "ts")
    got = flows.drain_windows(_counted(stream), close, "ending")
    rows = sorted(((r["key"], r["n"], r["total"], r["first"], r["last"]) for r in got.collect()), key=repr)
    want = [("1", 2, 3.0, at(0), at(5)), ("1", 2, 12.0, at(30), at(36)), ("2", 1, 0.0, at(31), at(31)), ("2", 1, 16.0, at(60), at(60)), (None, 1, 1.0, at(37), at(37))]
    assert rows == sorted(want, key=repr)


def test_counters_of_one_bucket_do_not_mix(spark, arrivals):
    """Calls are paid per bucket of keys: five hundred keys in one bucket, ends before, at and past the pause."""
    add, folder = arrivals
    schema = "key int, ts timestamp, v double"
    at = lambda k, minutes: T0 + dt.timedelta(minutes=minutes, seconds=k % 7)
    add([(k, at(k, 0), 1.0) for k in range(500)] + [(k, at(k, 10), 2.0) for k in range(500)], schema)
    add([(k, at(k, 20 + k % 3), 4.0) for k in range(500)], schema)
    stream, close = flows.closable(flows.read_files(spark, folder, schema, files_per_batch=1), "ts")
    got = flows.drain_windows(counters.ending_counters(stream, "key", "ts", "v", "10 minutes", "0 minutes", buckets=1), close, "one-bucket")
    want = []
    for k in range(500):
        want += [(str(k), 3, 7.0, at(k, 0), at(k, 20))] if k % 3 == 0 else [(str(k), 2, 3.0, at(k, 0), at(k, 10)), (str(k), 1, 4.0, at(k, 20 + k % 3), at(k, 20 + k % 3))]
    assert sorted((r["key"], r["n"], r["total"], r["first"], r["last"]) for r in got.collect()) == sorted(want)


def test_state_of_ending_counters_stays_bounded(spark, arrivals, tmp_path):
    """A hundred batches, each with new keys."""
    _, folder = arrivals
    schema = "key int, ts timestamp, v double"
    frame = spark.range(100).selectExpr("CAST(id AS INT) AS b").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    frame = frame.selectExpr("b * 5 + i AS key", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 6 * b) AS ts", "1D AS v", "b")
    rows = [tuple(r)[:3] for r in frame.orderBy("b", "key").collect()]
    for i in range(0, 500, 5):
        pd.DataFrame(rows[i : i + 5], columns=["key", "ts", "v"]).astype({"key": "int32", "ts": "datetime64[us]"}).to_parquet(f"{_made(folder)}/part-{i:04d}.parquet")
    stream = flows.read_files(spark, folder, "key int, ts timestamp_ntz, v double", files_per_batch=1)
    most, seen = 0, 0
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        query = _counted(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        for progress in query.recentProgress:
            seen += progress["numInputRows"] > 0
            most = max(most, *[op["numRowsTotal"] for op in progress["stateOperators"]], 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert seen >= 90 and 0 < most <= 100
    ended = spark.read.schema("key string, n long, total double, first timestamp, last timestamp").parquet(str(tmp_path / "out"))
    assert ended.count() == ended.select("key").distinct().count() >= 480


def test_a_closed_checkpoint_is_refused(spark, arrivals, tmp_path):
    add, folder = arrivals
    add([_post(1, 0)], POSTS)
    events, close = flows.closable(flows.read_files(spark, folder, POSTS), "ts")
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    stream = flows.tumbling(events, "ts", "0 minutes", "5 minutes", [], [F.count("*").alias("n")])
    assert flows.drain_windows(stream, close, "w", sink, checkpoint).count() == 1
    with pytest.raises(ValueError):
        flows.drain(stream, "w", sink, checkpoint)


def test_all_windows_come_out_over_several_batches(spark, tmp_path):
    """The last windows too; every file is a micro-batch of its own."""
    rows = [(f"k{i % 2}", f"2024-01-01 {i // 4:02d}:{i % 4 * 15:02d}:00") for i in range(60)]
    frame = spark.createDataFrame(rows, "k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    for i in range(5):
        frame.where(F.hour("ts").between(3 * i, 3 * i + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = flows.read_files(spark, str(tmp_path / "in"), frame.schema, files_per_batch=1)
    for name, spans in {
        "tumbling": lambda s: flows.tumbling(s, "ts", "1 day", "1 hour", ["k"], [F.count("*").alias("n")]),
        "sliding": lambda s: flows.sliding(s, "ts", "1 day", "2 hours", "1 hour", ["k"], [F.count("*").alias("n")]),
        "sessions": lambda s: flows.sessions(s, "ts", "1 day", "40 minutes", ["k"], [F.count("*").alias("n")]),
    }.items():
        events, close = flows.closable(stream, "ts")
        got = flows.drain_windows(spans(events), close, f"all-{name}").collect()
        want = {"tumbling": (30, 60), "sliding": (32, 120), "sessions": (2, 60)}[name]
        assert (len(got), sum(r["n"] for r in got)) == want

"""Catalogue lookups, rules, upserts, change logs and life cycles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeboard.operators import catalog as cat, collections as coll, lifecycle as life, ordered


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def test_latest_child_breaks_ties_by_id(spark):
    files = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("p", "c", 2), ("q", "d", 0)], "project string, id string, created int")
    assert _rows(cat.latest_child(files, "project", "created", "id"), "project", "id") == [("p", "c"), ("q", "d")]
    assert _rows(cat.first_child(files, "project", "id"), "project", "id") == [("p", "a"), ("q", "d")]


def test_child_counts_do_not_fan_out(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    a = spark.createDataFrame([(1,), (1,), (2,)], "fk int")
    b = spark.createDataFrame([(1,), (1,), (1,), (9,)], "fk int")
    got = cat.child_counts(parents, "id", {"n_a": (a, "fk"), "n_b": (b, "fk")})
    assert _rows(got) == [(1, 2, 3), (2, 1, 0), (3, 0, 0)]


@pytest.mark.parametrize("large", [5, 10_000])
def test_nested_children_pages_a_hot_parent(spark, monkeypatch, large):
    monkeypatch.setattr(ordered, "LARGE_GROUP", large)
    parents = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    children = spark.createDataFrame([(1, i) for i in range(25)] + [(2, 100)], "fk int, k int").repartition(4)
    got = cat.nested_children(parents, "id", children, "fk", ["k"], ["k"], page_size=10)
    sizes = {(r["id"], r["page"]): (r["n_children"], [c["k"] for c in r["children"] or []]) for r in got.collect()}
    assert sizes[1, 0] == (10, list(range(10))) and sizes[1, 2] == (5, list(range(20, 25)))
    assert sizes[2, 0] == (1, [100]) and sizes[3, 0] == (0, [])


def test_feed_flags(spark):
    posts = spark.createDataFrame([(i, i, "u1" if i % 2 else "u2") for i in range(60)], "id int, at int, author string")
    users = spark.createDataFrame([("u1", "Ann", "x"), ("u2", None, "y")], "uid string, name string, secret string")
    reactions = spark.createDataFrame([(59, "me"), (59, "you"), (58, "you")], "post int, who string")
    comments = spark.createDataFrame([(59, "me")], "post int, who string")
    got = cat.feed(posts, "id", "at", users, "author", "uid", ["name"], reactions, comments, "post", "who", "me")
    assert got.count() == 50 and "secret" not in got.columns
    by_id = {r["id"]: (r["has_reacted"], r["reaction_count"], r["comment_count"]) for r in got.collect()}
    assert by_id[59] == (True, 2, 1) and by_id[58] == (False, 1, 0) and by_id[10] == (False, 0, 0)
    assert 9 not in by_id


@pytest.mark.parametrize(
    "found, revoked, expires, uses, state",
    [
        (False, None, None, None, "missing"),
        (True, True, 0, 9, "revoked"),
        (True, False, 4, 9, "expired"),
        (True, False, 5, 3, "exhausted"),
        (True, False, 5, 2, "valid"),
        (True, False, 5, None, "valid"),
    ],
)
def test_invite_states(spark, found, revoked, expires, uses, state):
    df = spark.createDataFrame([(found, revoked, expires, uses)], "f boolean, r boolean, e int, u int")
    got = df.select(cat.invite_state(F.col("f"), F.col("r"), F.col("e"), F.col("u"), F.lit(3), F.lit(5)))
    assert got.first()[0] == state


def test_rules_report_the_first_failure(spark):
    df = spark.createDataFrame([(None,), ("",), ("x",), ("x" * 500,), ("x" * 501,), ("x" * 1001,)], "content string")
    rules = {"required": F.col("content").isNotNull(), "too short": F.length("content") >= 1, "too long": F.length("content") <= 500}
    got = [r["failure"] for r in cat.first_failure(df, rules).orderBy(F.length("content")).collect()]
    assert got == ["required", "too short", None, None, "too long", "too long"]
    assert _rows(cat.violation_counts(df, rules)) == [("required", 1), ("too long", 3), ("too short", 2)]
    assert cat.first_failure(df, {}).where("failure IS NOT NULL").count() == 0


def test_audits(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("b", None), (None, 2)], "k string, n int")
    assert _rows(cat.audit_unique(df, ["k", "n"], count="times")) == [("a", 1, 2)]
    parents = spark.createDataFrame([("a",)], "id string")
    assert _rows(cat.audit_fk(df, "k", parents, "id")) == [("b", 2)]
    assert _rows(cat.audit_nulls(df)) == [("k", 1), ("n", 2)]


def test_cascade(spark):
    a = spark.createDataFrame([(1,)], "a int")
    b = spark.createDataFrame([(10, 1), (20, 2)], "b int, a_fk int")
    c = spark.createDataFrame([(100, 10), (200, 20), (300, None)], "c int, b_fk int")
    kept = cat.cascade(a, [(b, "a_fk", "a"), (c, "b_fk", "b")])
    assert [_rows(t) for t in kept] == [[(1,)], [(10, 1)], [(100, 10)]]


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    updates = spark.createDataFrame([("b", 3, 1), ("b", None, 2), ("c", 5, 1), ("c", 4, 0)], "k string, v int, seq int")
    once = cat.upsert(base, updates, ["k"], "seq")
    assert _rows(once) == [("a", 1), ("b", None), ("c", 5)]
    assert _rows(cat.upsert(once, updates, ["k"], "seq")) == _rows(once)


def test_insert_missing_fills_only_gaps(spark):
    base = spark.createDataFrame([("a", "A", None), ("b", "B", "o1")], "id string, name string, org string")
    incoming = spark.createDataFrame([("a", "zzz", "o2"), ("b", "zzz", "o2"), ("c", "C", "o3"), ("c", "D", "o3")], base.schema)
    got = cat.insert_missing(base, incoming, "id", fill=["org"])
    assert _rows(got) == [("a", "A", "o2"), ("b", "B", "o1"), ("c", "C", "o3")]


def test_union_dedup_keeps_what_was_seen(spark):
    seen = spark.createDataFrame([(1, 0, "old")], "id int, at int, text string")
    incoming = spark.createDataFrame([(1, 5, "new"), (2, 7, "later"), (2, 6, "first")], seen.schema)
    assert _rows(coll.union_dedup(seen, incoming, "id", "at")) == [(1, 0, "old"), (2, 6, "first")]


def test_toggles(spark):
    log = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("c",), ("c",)], "k string")
    assert _rows(coll.toggle_parity(log, ["k"]), "k") == [("a",), ("c",)]
    left, right = spark.createDataFrame([("a",), ("b",), (None,)], "k string"), spark.createDataFrame([("b",), ("c",), ("c",)], "k string")
    assert _rows(coll.symmetric_difference(left, right)) == sorted([("a",), ("c",), (None,)], key=repr)


LOG = [
    ("a", 1, "create", "x", 1),
    ("a", 2, "update", None, 2),  # keeps the name
    ("b", 3, "create", "y", 1),
    ("b", 4, "delete", None, None),
    ("c", 5, "create", "z", 1),
    ("c", 6, "delete", None, None),
    ("c", 7, "update", "ghost", 9),  # not there: no effect
    ("c", 8, "create", "w", None),
    ("d", 9, "update", "ghost", 9),  # never created
    ("a", 10, "create", "again", 7),  # exists already: no effect
    ("e", 11, "delete", None, None),
    ("e", 12, "create", "v", 3),
    ("e", 13, "update", "u", None),
    ("e", 14, "update", None, 4),
]
STATE = [("a", "x", 2), ("c", "w", None), ("e", "u", 4)]
LOG_SCHEMA = "k string, seq bigint, op string, name string, n int"


def _replay(rows):
    """Plain replay of a change log, one event after the other."""
    state = {}
    for k, _, op, name, n in sorted(rows, key=lambda r: r[1]):
        if op == "create":
            state.setdefault(k, [name, n])
        elif op == "delete":
            state.pop(k, None)
        elif k in state:
            state[k] = [name if name is not None else state[k][0], n if n is not None else state[k][1]]
    return sorted(((k, *v) for k, v in state.items()), key=repr)


def test_apply_changes(spark):
    log = spark.createDataFrame(LOG, LOG_SCHEMA).repartition(4)
    assert _replay(LOG) == STATE
    assert _rows(coll.apply_changes(log, "k", "seq", "op", ["name", "n"])) == STATE


@pytest.mark.parametrize("seed", range(4))
def test_compacted_logs_add_up(spark, seed):
    import random

    rng = random.Random(seed)
    rows = []
    for seq in range(150):
        op = rng.choice(["create", "update", "update", "delete"])
        name, n = (rng.choice([None, "p", "q", "r"]), rng.choice([None, 1, 2, 3])) if op != "delete" else (None, None)
        rows.append((rng.choice("abcdefgh"), seq, op, name, n))
    args = ("k", "seq", "op", ["name", "n"])
    parts = [coll.compact_changes(spark.createDataFrame(rows[i : i + 40], LOG_SCHEMA), *args) for i in range(0, 150, 40)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    assert _rows(coll.apply_changes(union, *args)) == _replay(rows)


def test_life_cycle(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [("f", at(0), "pending"), ("f", at(5), "processing"), ("f", at(9), "completed"), ("g", at(1), "pending"), ("g", at(2), "completed")]
    log = spark.createDataFrame(rows, "file string, at timestamp_ntz, status string")
    assert _rows(life.current_status(log, "file", "status", ["at"]), "file", "status") == [("f", "completed"), ("g", "completed")]
    dwell = life.dwell_times(log, "file", "status", "at", ["at"])
    assert _rows(dwell.where("seconds IS NOT NULL"), "file", "status", "seconds") == [("f", "pending", 5.0), ("f", "processing", 4.0), ("g", "pending", 1.0)]
    assert _rows(life.forbidden_transitions(log, "file", "status", ["at"]), "file", "previous", "status") == [("g", "pending", "completed")]


def test_nested_children_of_parents_without_key_or_child(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, name string")
    children = spark.createDataFrame([(1, 5), (1, 4), (None, 9), (7, 8)], "fk long, k int")
    got = {r["name"]: (r["page"], [c["k"] for c in r["children"]], r["n_children"]) for r in cat.nested_children(parents, "id", children, "fk", ["k"], ["k"]).collect()}
    assert got == {"a": (0, [4, 5], 2), "b": (0, [], 0), "c": (0, [], 0)}

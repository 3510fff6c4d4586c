"""Deletes over graphs of references, against a fixpoint in plain Python."""

import random

import pytest

from gaugeboard.operators.cascades import SET_NULL, Reference, cascade_graph


def _random_graph(seed):
    """People who hang on people, teams that hang on people, people on teams: cycles of one and of two tables."""
    rng = random.Random(seed)
    pick = lambda n: rng.choice([None, *range(n)])
    people = [(i, pick(40), pick(8), pick(40)) for i in range(40)]
    teams = [(i, pick(40)) for i in range(8)]
    posts = [(i, pick(40), pick(8), pick(40)) for i in range(120)]
    return people, teams, posts


def _fixpoint(people, teams, posts, gone_people, gone_teams):
    while True:
        more_people = {p[0] for p in people if p[0] not in gone_people and (p[1] in gone_people or p[2] in gone_teams)}
        more_teams = {t[0] for t in teams if t[0] not in gone_teams and t[1] in gone_people}
        if not more_people and not more_teams:
            break
        gone_people, gone_teams = gone_people | more_people, gone_teams | more_teams
    left_people = [(*p[:3], None if p[3] in gone_people else p[3]) for p in people if p[0] not in gone_people]
    left_posts = [(*p[:3], None if p[3] in gone_people else p[3]) for p in posts if p[1] not in gone_people and p[2] not in gone_teams]
    return left_people, [t for t in teams if t[0] not in gone_teams], left_posts


@pytest.mark.parametrize("seed", range(3))
def test_graphs_with_cycles(spark, seed):
    people, teams, posts = _random_graph(seed)
    tables = {
        "people": spark.createDataFrame(people, "id int, boss int, team int, friend int"),
        "teams": spark.createDataFrame(teams, "id int, lead int"),
        "posts": spark.createDataFrame(posts, "id int, author int, team int, editor int"),
    }
    references = [
        Reference("people", ("boss",), "people"),
        Reference("people", ("team",), "teams"),
        Reference("people", ("friend",), "people", SET_NULL),
        Reference("teams", ("lead",), "people"),
        Reference("posts", ("author",), "people"),
        Reference("posts", ("team",), "teams"),
        Reference("posts", ("editor",), "people", SET_NULL),
    ]
    roots = {"people": tables["people"].where("id = 3"), "teams": tables["teams"].where("id IN (1, 5)")}
    done = cascade_graph(tables, {"people": ["id"], "teams": ["id"]}, references, roots)
    want = _fixpoint(people, teams, posts, {3}, {1, 5})
    for name, rows in zip(("people", "teams", "posts"), want):
        assert sorted(map(str, map(tuple, done.survivors(name).collect()))) == sorted(map(str, rows))
        deleted = done.deleted_keys(name)
        assert deleted is None or deleted.count() == deleted.distinct().count()


def test_a_long_chain_and_composite_keys(spark):
    steps = spark.range(12).selectExpr("id AS a", "id * 10 AS b", "CASE WHEN id > 0 THEN id - 1 END AS pa", "(id - 1) * 10 AS pb")
    leaves = spark.range(24).selectExpr("id", "id % 12 AS a", "id % 12 * 10 AS b")
    references = [Reference("steps", ("pa", "pb"), "steps"), Reference("leaves", ("a", "b"), "steps")]
    done = cascade_graph({"steps": steps, "leaves": leaves}, {"steps": ["a", "b"]}, references, {"steps": steps.where("a = 4")})
    assert done.rounds == 8
    assert sorted(r["a"] for r in done.survivors("steps").collect()) == [0, 1, 2, 3]
    assert sorted(r["id"] for r in done.survivors("leaves").collect()) == [0, 1, 2, 3, 12, 13, 14, 15]


def test_nothing_to_delete(spark):
    t = spark.range(3).selectExpr("id", "id AS up")
    references = [Reference("t", ("up",), "t")]
    absent = spark.createDataFrame([(99,), (None,)], "id long")
    done = cascade_graph({"t": t}, {"t": ["id"]}, references, {"t": absent})
    assert done.rounds == 0 and done.survivors("t").count() == 3 and done.deleted_keys("t") is None


def test_wrong_references_are_refused(spark):
    t = spark.range(1)
    with pytest.raises(ValueError):
        cascade_graph({"t": t}, {"t": ["id"]}, [Reference("t", ("id", "id"), "t")], {})
    with pytest.raises(ValueError):
        cascade_graph({"t": t}, {"t": ["id"]}, [Reference("t", ("id",), "t", "restrict")], {})

import itertools
import random

import pytest

from gaugeboard.llm import chat

ROLES = ["system", "user", "assistant", "tool", None]


def legal(roles):
    rest = roles[1:] if roles[:1] == [chat.SYSTEM] else roles
    return len(rest) >= 2 and len(rest) % 2 == 0 and all(r == (chat.USER, chat.ASSISTANT)[i % 2] for i, r in enumerate(rest))


def cheapest(roles):
    """Over all labels, merges and at most one empty message before each turn and two at the end."""
    best, between = 1 << 30, [(), (chat.USER,), (chat.ASSISTANT,)]
    for labels in itertools.product((chat.SYSTEM, chat.USER, chat.ASSISTANT), repeat=len(roles)):
        cost = sum(chat.GUESS if r is None else 0 if r == q else chat.RELABEL for r, q in zip(roles, labels))
        for joins in itertools.product((None, *between), repeat=len(roles)):
            if joins[0] is None or any(j is None and labels[i] != labels[i - 1] for i, j in enumerate(joins)):
                continue
            out = []
            for q, j in zip(labels, joins):
                out += [] if j is None else [*j, q]
            more = sum(chat.MERGE if j is None else chat.INSERT * len(j) for j in joins)
            for tail in ((), (chat.ASSISTANT,), (chat.USER, chat.ASSISTANT)):
                if legal([*out, *tail]):
                    best = min(best, cost + more + chat.INSERT * len(tail))
    return best


def cost_of(roles, found):
    return sum(c for *_, c in found) + chat.CLOSING[found[-1][0]][0]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_repairs_are_cheapest(n):
    rng = random.Random(n)
    cases = list(itertools.product([chat.role_of(r) for r in ROLES[:4]], repeat=n))
    for roles in rng.sample(cases, min(len(cases), 40)):
        found = chat.repair(list(roles))
        assert cost_of(roles, found) == cheapest(list(roles))
        messages = []
        for role, action, inserted, _ in found:
            messages += [] if action == "merge" else [inserted, role] if action == "insert" else [role]
        assert legal([*messages, *chat.CLOSING[found[-1][0]][1]])


@pytest.mark.parametrize("segment", [1, 2, 7, 13])
def test_segments_give_the_result_of_one_pass(segment):
    rng = random.Random(segment)
    for _ in range(1500):
        roles = [chat.role_of(rng.choice(ROLES)) for _ in range(rng.randint(1, 40))]
        parts = [roles[i : i + segment] for i in range(0, len(roles), segment)]
        found = []
        for part, (entry, leave) in zip(parts, chat.cuts([chat.matrix(p) for p in parts])):
            found += chat.repair(part, entry, leave)
        assert found == chat.repair(roles)


ROWS = [
    (1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"),
    (2, 0, "user", "one"), (2, 1, "user", "two"), (2, 2, "bot", None),
    (3, 0, "assistant", "hi"), (4, 0, "user", "<|im_start|>x<|im_end|>"), (5, None, None, None), (5, 1, "Assistant ", ""),
    (None, 0, "user", "n"), (None, 1, "assistant", "m"), (6, 0, "user", "q"), (6, 0, "user", "q"), (7, 3, "system", "only"),
]


def test_rendering(spark):
    turns = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "conv_id int, turn int, role string, text string, segment int, position int")
    found = chat.repaired(turns)
    assert found.count() == len(ROWS)
    whole = {r["conv_id"]: r for r in chat.conversations(found).collect()}
    end = "<|im_end|>\n"
    says = lambda role, text="": f"<|im_start|>{role}\n{text}{end}"
    assert whole[1]["rendered"] == says("system", "s") + says("user", "u") + says("assistant", "a") and whole[1]["cost"] == 0
    assert whole[2]["rendered"] == says("user", "one\ntwo") + says("assistant") and whole[2]["cost"] == chat.MERGE
    assert whole[3]["rendered"] == says("user") + says("assistant", "hi") and whole[3]["cost"] == chat.INSERT
    assert whole[4]["rendered"] == says("user", "< |im_start| >x< |im_end| >") + says("assistant")
    assert whole[5]["rendered"] == says("user") + says("assistant") and whole[5]["cost"] == chat.GUESS
    assert whole[6]["rendered"] == says("user", "q\nq") + says("assistant")
    assert whole[7]["rendered"] == says("system", "only") + says("user") + says("assistant")
    assert whole[None]["n_turns"] == 2


def test_a_long_chat_in_segments(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(ROLES), f"t{t}") for c, n in ((1, 400), (2, 3), (None, 95)) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    whole, cut = ({r["conv_id"]: tuple(r) for r in chat.conversations(chat.repaired(turns, segment=n)).collect()} for n in (1000, 16))
    assert whole == cut and whole[1][1] == 400
    one, many = (sorted((tuple(r) for r in chat.repaired(turns, segment=n).collect()), key=repr) for n in (1000, 9))
    assert one == many


def test_a_very_long_text(spark):
    text = "word " * 400_000
    found = chat.repaired(spark.createDataFrame([(1, 0, "user", text), (1, 1, None, text)], "conv_id long, turn long, role string, text string"))
    assert chat.conversations(found).first()["rendered"] == f"<|im_start|>user\n{text}<|im_end|>\n<|im_start|>assistant\n{text}<|im_end|>\n"


def test_empty_table(spark):
    assert chat.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0

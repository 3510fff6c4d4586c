"""Minimum-cost repair of the roles of chats, and their rendering.

A legal chat is an optional system message, then user and assistant in turn, the assistant last.
Each turn is given a role (its own, or another at a cost) and either begins a message, is merged
into the message before it if the roles agree, or begins a message after an inserted empty one.
A dynamic programme over the automaton's states finds the cheapest repair.

The cost of a run of turns from state to state is a small matrix, and such matrices multiply
(least sum).  So a chat longer than SEGMENT turns is cut into segments: each gives its matrix,
the matrices fix the states at the cuts, and every segment is then repaired on its own.  No task
holds a whole long chat.  Of equally cheap repairs the one counts that, read from the end, first has the
preferred move; a segment also tells which of its entry states leads to it, so that the result is
that of one pass, turn by turn, wherever the chat is cut.

Turns are ordered by turn (NULL first), then role and text; equal rows are turns of their own.
NULL text is empty.  A NULL or unknown role can be any role, at a small cost.  Turns whose chat is
NULL form one chat.  Ties: append before merge before insertion, system before user before assistant.
The markers of the format inside a text are broken up by spaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gaugeboard.llm.texts import column, text_column
from gaugeboard.operators.ordered import position_in_group
from gaugeboard.session import materialize

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
# Other names of the roles.
ALIASES = {
    "system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER,
    "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT,
}
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, GUESS, INSERT = 1, 3, 1, 2
#: What follows the last turn: the cost and the empty messages, by state.
CLOSING = {START: (2 * INSERT, (USER, ASSISTANT)), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}
SEGMENT = 1000
FAR = 1 << 40
STATES = range(4)


def role_of(name: str | None) -> int | None:
    return ALIASES.get((name or "").strip().lower())


def _moves() -> dict[int | None, list[tuple[int, int, int, str, int]]]:
    """For each role read: (from, to, cost, action, inserted role or START), in order of preference."""
    out: dict[int | None, list] = {}
    for read in (None, SYSTEM, USER, ASSISTANT):
        found = []
        for action in ("append", "merge", "insert"):
            for to in (SYSTEM, USER, ASSISTANT):
                cost = GUESS if read is None else 0 if read == to else RELABEL
                for state in STATES:
                    if action == "append" and to in NEXT[state]:
                        found.append((state, to, cost, action, START))
                    elif action == "merge" and state == to:
                        found.append((state, to, cost + MERGE, action, START))
                    elif action == "insert":
                        found += [(state, to, cost + INSERT, action, x) for x in NEXT[state] if to in NEXT[x] and to not in NEXT[state]]
        out[read] = found
    return out


MOVES = _moves()


def _steps(roles: list[int | None], entry: int) -> tuple[list[int], list[list[int | None]]]:
    """Least cost of each state after the turns, and for every turn the place in MOVES of the best move to each state."""
    costs, back = [FAR] * 4, []
    costs[entry] = 0
    for role in roles:
        step, how = [FAR] * 4, [None] * 4
        for at, (state, to, cost, _, _) in enumerate(MOVES[role]):
            if costs[state] + cost < step[to]:
                step[to], how[to] = costs[state] + cost, at
        costs = step
        back.append(how)
    return costs, back


def _path(roles: list[int | None], back: list[list[int | None]], leave: int) -> list[int]:
    """The places in MOVES of the best moves to a state, from the last turn to the first."""
    out, state = [], leave
    for role, how in zip(reversed(roles), reversed(back)):
        out.append(how[state])
        state = MOVES[role][how[state]][0]
    return out


def matrix(roles: list[int | None]) -> tuple[list[list[int]], list[list[int]]]:
    """From each state (row) to each state, over a run of turns: the least cost, and the rank of the row among those of equal cost."""
    found = [_steps(roles, entry) for entry in STATES]
    costs = [c for c, _ in found]
    ranks = [[0] * 4 for _ in STATES]
    for to in STATES:
        reached = [entry for entry in STATES if costs[entry][to] < FAR]
        for rank, entry in enumerate(sorted(reached, key=lambda e: _path(roles, found[e][1], to))):
            ranks[entry][to] = rank
    return costs, ranks


def repair(roles: list[int | None], entry: int = START, leave: int | None = None) -> list[tuple[int, str, int, int]]:
    """(role, action, inserted role, cost) of each turn, on the cheapest path from ``entry`` to ``leave`` (None: the end of the chat)."""
    costs, back = _steps(roles, entry)
    state = min(STATES, key=lambda s: costs[s] + CLOSING[s][0]) if leave is None else leave
    moves = [MOVES[role][at] for role, at in zip(roles, reversed(_path(roles, back, state)))]
    return [(to, action, inserted, cost) for _, to, cost, action, inserted in moves]


def cuts(matrices: list[tuple[list[list[int]], list[list[int]]]]) -> list[tuple[int, int | None]]:
    """(entry, leave) state of each segment of a chat; the last one's leave is open."""
    costs, back = [0, FAR, FAR, FAR], []
    for m, ranks in matrices:
        how = [min(STATES, key=lambda s: (costs[s] + m[s][to], ranks[s][to])) for to in STATES]
        costs = [min(FAR, costs[how[to]] + m[how[to]][to]) for to in STATES]
        back.append(how)
    state = min(STATES, key=lambda s: costs[s] + CLOSING[s][0])
    out: list[tuple[int, int | None]] = []
    for how in reversed(back):
        out.append((how[state], state))
        state = how[state]
    out = out[::-1]
    return [*out[:-1], (out[-1][0], None)] if out else []


def _plain(text: str | None) -> str:
    return (text or "").replace("<|im_start|>", "< |im_start| >").replace("<|im_end|>", "< |im_end| >")


def message(role: int, text: str = "") -> str:
    return f"<|im_start|>{NAMES[role]}\n{text}"


END = "<|im_end|>\n"


def render(found: list[tuple[int, str, int, int]], texts: list[str | None], first: bool, last: bool) -> list[str]:
    """The rendered piece of each turn; the pieces of a chat, one after another, are the chat."""
    out = []
    for i, ((role, action, inserted, _), text) in enumerate(zip(found, texts)):
        piece = ""
        if action == "merge":
            piece += "\n" + _plain(text)
        else:
            piece += "" if first and i == 0 else END
            piece += message(inserted) + END if action == "insert" else ""
            piece += message(role, _plain(text))
        out.append(piece)
    if last and out:
        out[-1] += END + "".join(message(r) + END for r in CLOSING[found[-1][0]][1])
    return out


def _runs(batches: Iterator[pa.RecordBatch]):
    """(chat, segment, rows) in order, from rows sorted by chat, segment and position."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            here = (row["conv_id"], row["segment"])
            if here != key and held:
                yield key, held
                held = []
            key = here
            held.append(row)
    if held:
        yield key, held


def _matrices(id_type: pa.DataType):
    def rows(batches):
        found = [(conv, segment, [x for part in matrix([role_of(r["role"]) for r in held]) for row in part for x in row]) for (conv, segment), held in _runs(batches)]
        ids, segments, costs = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(segments, pa.int64()), pa.array(costs, pa.list_(pa.int64()))], ["conv_id", "segment", "costs"])

    return rows


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches).sort_by("segment")
    found = cuts([tuple([c[at + 4 * s : at + 4 * s + 4] for s in STATES] for at in (0, 16)) for c in table.column("costs").to_pylist()])
    entry, leave = zip(*found)
    out = table.select(["conv_id", "segment"]).append_column("entry", pa.array(entry, pa.int32())).append_column("leave", pa.array(leave, pa.int32()))
    yield from out.combine_chunks().to_batches()


def _repair(schema: pa.Schema):
    def rows(batches):
        out: dict[str, list] = {n: [] for n in schema.names}
        for (conv, segment), held in _runs(batches):
            found = repair([role_of(r["role"]) for r in held], held[0]["entry"] or START, held[0]["leave"])
            texts = render(found, [r["text"] for r in held], segment == 0, held[0]["leave"] is None)
            for row, (role, action, inserted, cost), piece in zip(held, found, texts):
                out["conv_id"].append(conv)
                out["turn"].append(row["turn"])
                out["position"].append(row["position"])
                out["role"].append(row["role"])
                out["repaired_role"].append(NAMES[role])
                out["action"].append(action)
                out["inserted"].append(NAMES.get(inserted))
                out["cost"].append(cost)
                out["piece"].append(piece)
            if held[0]["leave"] is None:
                out["cost"][-1] += CLOSING[found[-1][0]][0]
            if len(out["turn"]) >= 2000:
                yield pa.RecordBatch.from_pydict(out, schema)
                out = {n: [] for n in schema.names}
        yield pa.RecordBatch.from_pydict(out, schema)

    return rows


def repaired(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", segment: int = SEGMENT) -> DataFrame:
    """One row per turn: conv_id, turn, position, role, repaired_role, action, inserted, cost, piece.

    ``cost`` is the turn's share of its chat's cost; the last turn's holds that of what follows it.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    conv = column(turns, conv_col)
    conv = conv if conv_col in turns.columns else conv.cast("long")
    rows = turns.select(conv.alias("conv_id"), column(turns, turn_col).cast("long").alias("turn"), text_column(turns, role_col).alias("role"), text_column(turns, text_col).alias("text"))
    placed = position_in_group(rows, ["conv_id"], ["turn", "role", "text"])
    placed = materialize(placed.withColumn("segment", F.floor((F.col("position") - 1) / segment).cast("long")), "turns")
    id_type = to_arrow_type(placed.schema["conv_id"].dataType)
    long = placed.filter("segment > 0").select(F.col("conv_id").alias("long_id")).distinct()

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "position")

    cut = placed.select("conv_id", "segment", "position", "role").join(long, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi")
    costs = in_order(cut).mapInArrow(_matrices(id_type), T.StructType([placed.schema["conv_id"], placed.schema["segment"], T.StructField("costs", T.ArrayType(T.LongType()))]))
    states = costs.groupBy("conv_id").applyInArrow(_cut, T.StructType([placed.schema["conv_id"], placed.schema["segment"], T.StructField("entry", T.IntegerType()), T.StructField("leave", T.IntegerType())]))
    states = materialize(states, "states").select(F.col("conv_id").alias("cut_id"), F.col("segment").alias("cut_segment"), "entry", "leave")
    same = F.col("conv_id").eqNullSafe(F.col("cut_id")) & (F.col("segment") == F.col("cut_segment"))
    given = placed.join(states, same, "left").drop("cut_id", "cut_segment")
    fields = [placed.schema["conv_id"], T.StructField("turn", T.LongType()), T.StructField("position", T.LongType())]
    fields += [T.StructField(n, T.StringType()) for n in ("role", "repaired_role", "action", "inserted")] + [T.StructField("cost", T.LongType()), T.StructField("piece", T.StringType())]
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields])
    return in_order(given).mapInArrow(_repair(arrow), T.StructType(fields))


def conversations(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, cost and the rendered chat; for chats that fit a row."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "piece")))
    found = pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("cost").alias("cost"), ordered.alias("turns"))
    return found.select("conv_id", "n_turns", "cost", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("rendered"))

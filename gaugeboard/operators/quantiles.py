"""Exact quantiles without gathering the values in one task.

Whole columns: mergeable sketches propose cut values, one counting pass says
between which cuts each wanted rank lies, and the passes repeat on that narrow
interval.  A rank that falls on a cut is settled; intervals of bounded size are
read out exactly.  The sketch only steers the search: the counts decide, so the
answer is exact whatever the sketch error.  All columns are searched together: a round is
one scan for the sketches and one for the counts, however many columns there are.

Groups: values are counted per (group, value) first, then running counts locate the
ranks; a group with very many different values is cut into ranges for that.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gaugeboard.functions.kinds import double_literal, number, number_sql, quoted
from gaugeboard.operators.ordered import running_totals
from gaugeboard.session import materialize

# Values read out at once, of all columns together; size of a sketch; share of the values its cuts may be off.
READ_OUT = 100_000
SKETCH_SIZE = 8192
MARGIN = 0.001
# Stands for a missing key; before all others.
NO_KEY = -(2**63 - 1)


def _wanted_ranks(n: int, p: float) -> tuple[int, int, float]:
    """0-based ranks around quantile ``p`` and the weight of the upper one."""
    place = (n - 1) * p
    low = math.floor(place)
    return low, math.ceil(place), place - low


class _Value:
    """SQL text of a number to search in, as double or as whole number."""

    def __init__(self, sql: str, whole: bool = False):
        self.sql = sql
        self.literal = (lambda v: f"{v}L") if whole else double_literal
        self.sketch = "bigint" if whole else "double"


class _Interval:
    """Open interval of one column that holds some wanted ranks.

    ``before`` values lie at or below ``low``; ``size`` values lie inside.
    """

    def __init__(self, column, value, ranks, before, size, low=None, high=None):
        self.column, self.value, self.ranks = column, value, sorted(ranks)
        self.before, self.size = before, size
        self.low, self.high = low, high

    def inside(self, sql: str) -> str:
        """SQL test: strictly between the ends; an open end is not limited."""
        tests = [f"{sql} IS NOT NULL"]
        if self.low is not None:
            tests.append(f"{sql} > {self.value.literal(self.low)}")
        if self.high is not None:
            tests.append(f"{sql} < {self.value.literal(self.high)}")
        return " AND ".join(tests)


def _aggregate(df: DataFrame, parts: list[_Interval], sql) -> list:
    """One aggregate per interval, all in one pass, brought to the driver."""
    exprs = []
    for part in parts:
        value = part.value.sql
        exprs.append(sql(part, f"CASE WHEN {part.inside(value)} THEN {value} END"))
    return list(df.agg(*[F.expr(e).alias(f"a{i}") for i, e in enumerate(exprs)]).first())


def _read_out(df: DataFrame, parts: list[_Interval], found: dict) -> None:
    """Pick the wanted ranks from intervals of bounded size."""

    def picks(part: _Interval, value: str) -> str:
        places = ", ".join(str(r - part.before) for r in part.ranks)
        return f"transform(array({places}), r -> get(v, r))".join(
            ("element_at(transform(array(sort_array(collect_list(" + value + "))), v -> ", "), 1)")
        )

    for part, values in zip(parts, _aggregate(df, parts, picks)):
        found.update({(part.column, r): v for r, v in zip(part.ranks, values)})


def _shares(part: _Interval) -> str:
    """SQL array of the places near the wanted ranks, below and above them, as shares of the interval.

    Ranks next to each other share their places.
    """
    shares: list[float] = []
    for r in part.ranks:
        share = (r - part.before + 0.5) / part.size
        for near in (max(0.0, share - MARGIN), share, min(1.0, share + MARGIN)):
            if all(abs(near - s) > MARGIN / 4 for s in shares):
                shares.append(near)
    return f"array({', '.join(double_literal(s) for s in sorted(shares))})"


def _sketch_cuts(part: _Interval, value: str) -> str:
    """SQL array of values near the wanted ranks, below and above them."""
    kind = part.value.sketch
    return f"kll_sketch_get_quantile_{kind}(kll_sketch_agg_{kind}({value}, {SKETCH_SIZE}), {_shares(part)})"


def _narrow(df: DataFrame, parts: list[_Interval], found: dict, cuts: list[list] | None = None) -> list[_Interval]:
    """One sketch pass, unless ``cuts`` are known, and one counting pass for all intervals; returns those still open.

    Counting tells for every cut how many values of its interval lie below it and up to it.
    """
    cuts = [sorted(set(c)) for c in cuts or _aggregate(df, parts, _sketch_cuts)]
    values = df.selectExpr(*[f"CASE WHEN {part.inside(part.value.sql)} THEN {part.value.sql} END AS v{i}" for i, part in enumerate(parts)])
    tests = [f"v{i} {sign} {part.value.literal(c)}" for i, part in enumerate(parts) for c in cuts[i] for sign in ("<", "<=")]
    upto = iter(values.agg(*[F.expr(f"count_if({test})").alias(f"n{k}") for k, test in enumerate(tests)]).first())
    # Places of an interval: below its first cut, on it, between it and the next, ...
    counts = {}
    for i, part in enumerate(parts):
        edges = [0, *[next(upto) for _ in range(2 * len(cuts[i]))], part.size]
        counts.update({(i, place): z - a for place, (a, z) in enumerate(zip(edges, edges[1:]))})

    still_open = []
    for i, part in enumerate(parts):
        start, low = part.before, part.low
        for place in range(2 * len(cuts[i]) + 1):
            end = start + counts.get((i, place), 0)
            ranks = [r for r in part.ranks if start <= r < end]
            if place % 2:
                low = cuts[i][place // 2]
                found.update({(part.column, r): low for r in ranks})
            elif ranks:
                high = cuts[i][place // 2] if place // 2 < len(cuts[i]) else part.high
                still_open.append(_Interval(part.column, part.value, ranks, start, end - start, low, high))
            start = end
    return still_open


def _search(df: DataFrame, parts: list[_Interval]) -> dict[tuple[str, int], float]:
    """The values at all wanted ranks."""
    found: dict[tuple[str, int], float] = {}
    while parts:
        parts = sorted(parts, key=lambda p: p.size)
        upto = [sum(p.size for p in parts[: i + 1]) for i in range(len(parts))]
        small = [p for p, total in zip(parts, upto) if total <= READ_OUT]
        if small:
            _read_out(df, small, found)
        parts = parts[len(small) :]
        parts = _narrow(df, parts, found) if parts else []
    return found


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Interpolated quantiles per column, as ``percentile`` defines them.

    Only a few cut values and counts per column reach the driver.
    """
    if not cols:
        return {}
    sizes = df.agg(*[F.expr(f"count({number_sql(df, c)})").alias(f"n{i}") for i, c in enumerate(cols)]).first()
    n_of = {c: sizes[f"n{i}"] for i, c in enumerate(cols)}
    parts = []
    for c in cols:
        if n_of[c]:
            ranks = {r for p in probs for r in _wanted_ranks(n_of[c], p)[:2]}
            parts.append(_Interval(c, _Value(number_sql(df, c)), ranks, 0, n_of[c]))
    found = _search(df, parts)

    def interpolate(column: str, p: float) -> float | None:
        if not n_of[column]:
            return None
        low, high, weight = _wanted_ranks(n_of[column], p)
        a, b = found[column, low], found[column, high]
        return a if low == high else (1 - weight) * a + weight * b

    return {c: [interpolate(c, p) for p in probs] for c in cols}


def middle_facts(col: str) -> dict[str, str]:
    """SQL aggregates of what ``middle_value`` has to know of a whole-number column before it searches."""
    value = f"CAST({quoted(col)} AS BIGINT)"
    return {"present": f"count({value})", "sketch": f"kll_sketch_agg_bigint({value}, {SKETCH_SIZE})"}


def middle_value(df: DataFrame, col: str, n: int | None = None, known: dict | None = None) -> tuple[bool, int | None]:
    """Whether there is a row of rank floor(n / 2), counted from 1 with NULLs first, and its whole-number value.

    ``n`` rows and ``known`` ``middle_facts`` save a pass each.
    """
    value = f"CAST({quoted(col)} AS BIGINT)"
    if known is None:
        n, present = df.agg(F.count(F.lit(1)), F.expr(f"count({value})")).first()
    else:
        present = known["present"]
    rank = n // 2 - 1 - (n - present)
    if n < 2 or rank < 0:
        return n >= 2, None
    part, found = _Interval(col, _Value(value, whole=True), [rank], 0, present), {}
    parts = [part]
    if known is not None and present > READ_OUT:
        sketch = f"X'{bytes(known['sketch']).hex()}'"
        cuts = df.sparkSession.range(1).selectExpr(f"kll_sketch_get_quantile_bigint({sketch}, {_shares(part)}) AS cuts").first()["cuts"]
        parts = _narrow(df, parts, found, [cuts])
    return True, (found | _search(df, parts))[col, rank]


def rows_at_ranks(df: DataFrame, orders: dict[str, str], key: str, ranks: Sequence[int]) -> dict[str, list[tuple]]:
    """(value, key) of the rows at 0-based ``ranks`` for each SQL double of ``orders``, which is never missing; ties go by the whole-number ``key``.

    All orders are searched together: first the values at the ranks, then how many rows come before each of
    them, then the keys among the rows of that value.  A missing key counts as ``NO_KEY``.
    """
    n = df.agg(F.count(F.lit(1))).first()[0]
    ranks = [r for r in ranks if 0 <= r < n]
    if not ranks:
        return {name: [] for name in orders}
    at = _search(df, [_Interval(name, _Value(sql), set(ranks), 0, n) for name, sql in orders.items()])
    wanted = sorted({(name, at[name, r]) for name in orders for r in ranks})
    tests = [(orders[name], double_literal(v)) for name, v in wanted]
    counts = df.agg(*[F.expr(f"named_struct('before', count_if({sql} < {v}), 'same', count_if({sql} = {v}))").alias(f"c{i}") for i, (sql, v) in enumerate(tests)]).first()
    before = {w: counts[i]["before"] for i, w in enumerate(wanted)}
    parts = []
    for i, (name, v) in enumerate(wanted):
        inside = {r - before[name, v] for r in ranks if at[name, r] == v}
        own = f"CASE WHEN {tests[i][0]} = {tests[i][1]} THEN coalesce(CAST({quoted(key)} AS BIGINT), {NO_KEY}L) END"
        parts.append(_Interval((name, v), _Value(own, whole=True), inside, 0, counts[i]["same"]))
    keys = _search(df, parts)
    return {name: [(at[name, r], keys[(name, at[name, r]), r - before[name, at[name, r]]]) for r in ranks] for name in orders}


def grouped_quantiles(df: DataFrame, group_by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group: group columns and one column per entry of ``probs``."""
    groups = list(group_by)
    # Stored, because the counts are read three times and the table only once.
    counted = materialize(
        df.select(*groups, number(df, value).alias("__v"))
        .where(F.col("__v").isNotNull())
        .groupBy(*groups, "__v")
        .agg(F.count(F.lit(1)).alias("__n")),
        "counts",
    )
    ranked = running_totals(counted, groups, ["__v"], {"__upto": "__n"})
    sizes = counted.groupBy(*groups).agg(F.sum("__n").alias("__size"))
    renamed = sizes.select(*[F.col(g).alias(f"__k_{g}") for g in groups], "__size")
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__k_{g}"))
    located = ranked.join(renamed, same)
    aggs = []
    for out, p in probs.items():
        place = (F.col("__size") - 1) * F.lit(p)
        low, high = F.floor(place), F.ceil(place)
        at = lambda rank: F.max(  # noqa: E731 - the value whose counts cover the rank
            F.when((rank >= F.col("__upto") - F.col("__n")) & (rank < F.col("__upto")), F.col("__v"))
        )
        weight = F.max(place - low)
        aggs.append(((1 - weight) * at(low) + weight * at(high)).alias(out))
    return located.groupBy(*groups).agg(*aggs)

"""Deletes that follow a graph of foreign keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gaugeboard.session import materialize

CASCADE, SET_NULL = "cascade", "set null"


@dataclass(frozen=True)
class Reference:
    """``child.columns`` name a row of ``parent`` by its key; ``rule`` says what a delete of that row does to the child."""

    child: str
    columns: tuple[str, ...]
    parent: str
    rule: str = CASCADE


@dataclass
class Deleted:
    """What a delete has reached: the keys of deleted rows of every table that others refer to."""

    tables: Mapping[str, DataFrame]
    keys: Mapping[str, Sequence[str]]
    references: Sequence[Reference]
    gone: dict[str, list[DataFrame]] = field(default_factory=dict)
    rounds: int = 0

    def deleted_keys(self, name: str) -> DataFrame | None:
        """Distinct keys of the deleted rows of a table; None if there are none."""
        parts = self.gone.get(name)
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _hits(self, name: str, columns: Sequence[str], keys: DataFrame, how: str) -> DataFrame:
        marks = keys.toDF(*[f"__k{i}" for i in range(len(keys.columns))])
        table = self.tables[name]
        same = reduce(lambda a, b: a & b, [table[c] == marks[f"__k{i}"] for i, c in enumerate(columns)])
        return table.join(marks, same, how)

    def survivors(self, name: str) -> DataFrame:
        """The rows of a table that are left, with foreign keys emptied where the rule says so.

        A table that others refer to loses the rows whose keys are gone; any other table is joined once per reference.
        """
        out = self.tables[name]
        own = self.deleted_keys(name)
        if own is not None:
            out = self._without(out, self.keys[name], own)
        for ref in self.references:
            if ref.child != name or (gone := self.deleted_keys(ref.parent)) is None:
                continue
            if ref.rule == SET_NULL:
                marks = gone.toDF(*[f"__k{i}" for i in range(len(gone.columns))]).withColumn("__gone", F.lit(True))
                out = out.join(marks, self._same(out, ref.columns, marks), "left")
                emptied = {c: F.when(F.col("__gone"), F.lit(None)).otherwise(F.col(c)) for c in ref.columns}
                out = out.withColumns(emptied).drop(*marks.columns)
            elif own is None:
                out = self._without(out, ref.columns, gone)
        return out

    @staticmethod
    def _same(table: DataFrame, columns: Sequence[str], marks: DataFrame):
        return reduce(lambda a, b: a & b, [table[c] == marks[f"__k{i}"] for i, c in enumerate(columns)])

    def _without(self, table: DataFrame, columns: Sequence[str], keys: DataFrame) -> DataFrame:
        marks = keys.toDF(*[f"__k{i}" for i in range(len(keys.columns))])
        return table.join(marks, self._same(table, columns, marks), "left_anti")


def cascade_graph(
    tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], references: Sequence[Reference], roots: Mapping[str, DataFrame]
) -> Deleted:
    """Follow the deletes of ``roots`` (keys to delete by table) over all references, cycles included.

    A fixpoint by rounds: only keys deleted in the last round are joined to the tables that refer to them, so every
    deleted key meets each of its references once.  Tables that nothing refers to take no part in the rounds.
    A table may have several parents, or itself as one; a row without a foreign key stays.
    ``keys`` names the key columns of tables with children or in ``roots``.  Each round's keys are written tables.
    """
    for ref in references:
        if ref.rule not in (CASCADE, SET_NULL):
            raise ValueError(f"unknown rule {ref.rule!r}")
        if len(ref.columns) != len(keys[ref.parent]):
            raise ValueError(f"{ref.child} refers to {ref.parent} by {len(ref.columns)} columns, its key has {len(keys[ref.parent])}")
    followed = [r for r in references if r.rule == CASCADE]
    out = Deleted(tables, keys, references)
    inner = {r.parent for r in references} | set(roots)
    fresh = {}
    for name, rows in roots.items():
        # Keys that no row has delete nothing.
        asked = rows.select(*keys[name]).distinct()
        found = materialize(out._hits(name, keys[name], asked, "left_semi").select(*keys[name]).distinct(), "deleted")
        if not found.isEmpty():
            fresh[name] = found
    while fresh:
        out.rounds += 1
        for name, rows in fresh.items():
            out.gone.setdefault(name, []).append(rows)
        reached = {}
        for name in sorted(inner):
            hits = [out._hits(name, r.columns, fresh[r.parent], "left_semi").select(*keys[name]) for r in followed if r.child == name and r.parent in fresh]
            if not hits:
                continue
            new = reduce(DataFrame.unionByName, hits).distinct()
            known = out.deleted_keys(name)
            new = materialize(new if known is None else new.join(known, list(keys[name]), "left_anti"), "deleted")
            if not new.isEmpty():
                reached[name] = new
        fresh = reached
    return out

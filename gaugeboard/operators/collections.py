"""Set operations, toggles and change logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def union_dedup(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Existing rows plus incoming rows with unseen keys; the first copy by ``order`` counts."""
    rest = [c for c in incoming.columns if c != key]
    once = incoming.groupBy(key).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias("__in"))
    once = once.select(key, *[F.col(f"__in.{c}").alias(c) for c in rest])
    return existing.unionByName(once.join(existing, key, "left_anti"))


def toggle_parity(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are present after every toggle in the log: an odd number of them."""
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_toggles")).where(F.col("n_toggles") % 2 == 1)


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that occur in exactly one of two tables; one shuffle."""
    cols = left.columns
    marked = left.select(*cols, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(
        right.select(*cols, F.lit(0).alias("__l"), F.lit(1).alias("__r"))
    )
    sides = marked.groupBy(*cols).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r"))
    return sides.where(F.col("__l") != F.col("__r")).select(*cols)


CREATE, UPDATE, DELETE = "create", "update", "delete"


def _fold(log: DataFrame, key: str, seq: str, op: str, attrs: Sequence[str]) -> DataFrame:
    """Per key: last delete, first create after it, latest value of each attribute after it."""
    deletes = log.where(F.col(op) == DELETE).groupBy(F.col(key).alias("__k")).agg(F.max(seq).alias("__deleted"))
    live = log.where(F.col(op) != DELETE).join(deletes, F.col(key) == F.col("__k"), "left")
    live = live.where(F.col("__deleted").isNull() | (F.col(seq) > F.col("__deleted")))
    created = F.when(F.col(op) == CREATE, F.struct(F.col(seq).alias("seq"), *attrs))
    latest = [
        F.max(F.when((F.col(op) == UPDATE) & F.col(a).isNotNull(), F.struct(F.col(seq).alias("seq"), F.col(a).alias("value")))).alias(f"__u_{a}")
        for a in attrs
    ]
    return live.groupBy(key).agg(F.min(created).alias("__c"), *latest)


def apply_changes(log: DataFrame, key: str, seq: str, op: str, attrs: Sequence[str]) -> DataFrame:
    """Final rows after create, partial update and delete events.

    An update leaves attributes it does not carry unchanged.  Events on a key that
    does not exist, and a create of one that does, have no effect.
    """
    folded = _fold(log, key, seq, op, attrs).where(F.col("__c").isNotNull())
    value: dict[str, Column] = {}
    for a in attrs:
        newer = F.col(f"__u_{a}.seq") > F.col("__c.seq")
        value[a] = F.when(newer, F.col(f"__u_{a}.value")).otherwise(F.col(f"__c.{a}"))
    return folded.select(key, *[v.alias(a) for a, v in value.items()])


def compact_changes(log: DataFrame, key: str, seq: str, op: str, attrs: Sequence[str]) -> DataFrame:
    """A shorter log with the same effect: per key a delete, a create, one update per attribute.

    Compacted logs can be appended to each other and applied together.
    """
    types = {f.name: f.dataType for f in log.schema.fields}

    def row(at: Column, what: str, values: dict[str, Column]) -> Column:
        return F.struct(
            at.alias(seq),
            F.lit(what).alias(op),
            *[values.get(a, F.lit(None)).cast(types[a]).alias(a) for a in attrs],
        )

    create = F.when(F.col("__c").isNotNull(), row(F.col("__c.seq"), CREATE, {a: F.col(f"__c.{a}") for a in attrs}))
    updates = [
        F.when(F.col(f"__u_{a}").isNotNull(), row(F.col(f"__u_{a}.seq"), UPDATE, {a: F.col(f"__u_{a}.value")})) for a in attrs
    ]
    kept = _fold(log, key, seq, op, attrs).select(key, F.inline(F.array_compact(F.array(create, *updates))))
    deletes = log.where(F.col(op) == DELETE).groupBy(key).agg(F.max(seq).alias(seq))
    deletes = deletes.select(key, seq, F.lit(DELETE).alias(op), *[F.lit(None).cast(types[a]).alias(a) for a in attrs])
    return deletes.unionByName(kept)

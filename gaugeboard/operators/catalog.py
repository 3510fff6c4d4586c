"""Relational lookups of a dataset catalogue: latest children, counts, joins, rules.

Joins carry no broadcast hints: adaptive execution broadcasts a side only when its
measured size allows, and otherwise splits hot keys of the shuffled join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gaugeboard.operators.ordered import position_in_group
from gaugeboard.operators.profile import first_rows
from gaugeboard.session import materialize

FEED_PAGE = 50
PAGE_SIZE = 1000


def tenant_filter(df: DataFrame, tenant_col: str, tenant) -> DataFrame:
    """Rows of one tenant; store tables partitioned by tenant to prune files."""
    return df.where(F.col(tenant_col) == tenant)


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows whose key columns equal the given values."""
    for name, value in keys.items():
        df = df.where(F.col(name) == value)
    return df


def extreme_child(child: DataFrame, fk: str, order: Sequence[str], latest: bool = True) -> DataFrame:
    """The last (or first) child of each parent by ``order``, ties settled by its tail.

    Aggregates structs instead of ranking, so a parent with very many children
    is reduced before the shuffle.
    """
    names = [c for c in child.columns if c != fk]
    ranked = F.struct(*order, *[c for c in names if c not in order])
    best = (F.max if latest else F.min)(ranked)
    return child.groupBy(fk).agg(best.alias("__best")).select(fk, *[F.col(f"__best.{c}").alias(c) for c in names])


def latest_child(child: DataFrame, fk: str, ts: str, tie: str) -> DataFrame:
    """The newest child per parent; of equal times the one with the largest ``tie``."""
    return extreme_child(child, fk, [ts, tie])


def first_child(child: DataFrame, fk: str, key: str) -> DataFrame:
    """The child with the smallest key per parent."""
    return extreme_child(child, fk, [key], latest=False)


def child_counts(parent: DataFrame, pk: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Parent rows with one count column per child table.

    Each child is counted before its join, so the tables do not fan out.
    """
    out = parent
    for name, (child, fk) in children.items():
        counts = child.groupBy(F.col(fk).alias("__fk")).agg(F.count(F.lit(1)).alias(f"__{name}"))
        out = (
            out.join(counts, F.col(pk) == F.col("__fk"), "left")
            .withColumn(name, F.coalesce(f"__{name}", F.lit(0)))
            .drop("__fk", f"__{name}")
        )
    return out


def any_match(parent: DataFrame, pk: str, child: DataFrame, fk: str, condition: Column, name: str) -> DataFrame:
    """Parent rows with a flag: does any child satisfy the condition?"""
    hits = child.where(condition).select(F.col(fk).alias("__fk")).distinct()
    return parent.join(hits, F.col(pk) == F.col("__fk"), "left").withColumn(name, F.col("__fk").isNotNull()).drop("__fk")


def newest(df: DataFrame, ts: str, key: str, n: int = FEED_PAGE) -> DataFrame:
    """The newest ``n`` rows; ties go to the larger key."""
    return first_rows(df, [ts, key], n, descending=True)


def join_parent(child: DataFrame, fk: str, parent: DataFrame, pk: str, keep: Sequence[str] | None = None, how: str = "inner") -> DataFrame:
    """Child rows with their parent's columns, or only those in ``keep``."""
    if keep is not None:
        parent = parent.select(pk, *[c for c in keep if c != pk])
    return child.join(parent, child[fk] == parent[pk], how)


def feed(
    posts: DataFrame,
    post_id: str,
    ts: str,
    users: DataFrame,
    user_fk: str,
    user_pk: str,
    user_cols: Sequence[str],
    reactions: DataFrame,
    comments: DataFrame,
    child_fk: str,
    reactor: str,
    current_user,
    n: int = FEED_PAGE,
) -> DataFrame:
    """The newest posts with author, counts, and whether the current user reacted.

    The page is cut and stored first; its at most ``n`` post ids then restrict the child scans.
    """
    page = materialize(newest(posts, ts, post_id, n), "page")
    ids = F.broadcast(page.select(F.col(post_id).alias("__post")))

    def per_post(child: DataFrame, *aggs: Column) -> DataFrame:
        return child.join(ids, F.col(child_fk) == F.col("__post"), "left_semi").groupBy(F.col(child_fk).alias("__post")).agg(*aggs)

    mine = F.count_if(F.col(reactor) == current_user)
    reacted = per_post(reactions, F.count(F.lit(1)).alias("__r"), mine.alias("__mine"))
    commented = per_post(comments, F.count(F.lit(1)).alias("__c")).withColumnRenamed("__post", "__cpost")
    authors = users.select(user_pk, *user_cols)
    return (
        page.join(authors, page[user_fk] == authors[user_pk], "inner")
        .join(reacted, F.col(post_id) == F.col("__post"), "left")
        .join(commented, F.col(post_id) == F.col("__cpost"), "left")
        .withColumns(
            {
                "has_reacted": F.coalesce(F.col("__mine") > 0, F.lit(False)),
                "reaction_count": F.coalesce("__r", F.lit(0)),
                "comment_count": F.coalesce("__c", F.lit(0)),
            }
        )
        .drop("__post", "__cpost", "__r", "__c", "__mine")
    )


def nested_children(
    parent: DataFrame,
    pk: str,
    child: DataFrame,
    fk: str,
    order_by: Sequence[str],
    fields: Sequence[str],
    page_size: int = PAGE_SIZE,
) -> DataFrame:
    """Parents with their children as ordered arrays, paged.

    A parent gets one row per ``page_size`` children (page 0 with an empty array
    if it has none), so no row has to hold an unbounded collection.
    """
    kept = list(dict.fromkeys([*order_by, *fields]))
    children = child.select(fk, *[c for c in kept if c != fk]).where(F.col(fk).isNotNull())
    placed = position_in_group(children, [fk], order_by, "__at")
    page = F.floor((F.col("__at") - 1) / page_size).cast("bigint")
    entries = placed.select(F.col(fk).alias("__fk"), page.alias("page"), F.struct("__at", F.struct(*fields).alias("child")).alias("__entry"))
    # Every parent asks for its page 0, so those without a child need no search of their own.
    asked = parent.select(F.col(pk).alias("__fk"), F.lit(0).cast("bigint").alias("page"), F.lit(None).cast(entries.schema["__entry"].dataType).alias("__entry"))
    pages = (
        entries.unionByName(asked)
        .groupBy("__fk", "page")
        .agg(F.sort_array(F.collect_list("__entry")).alias("__entries"))
        .select("__fk", "page", F.transform("__entries", lambda e: e.getField("child")).alias("children"))
    )
    # An inner join can split the pages of a hot parent; a left join could not.
    paged = parent.join(pages, F.col(pk).eqNullSafe(F.col("__fk"))).drop("__fk")
    return paged.withColumn("n_children", F.size("children").cast("bigint"))


def members(df: DataFrame, key: str, allowed: DataFrame, allowed_key: str) -> DataFrame:
    """Rows whose key occurs in another table; repeated keys there shuffle once."""
    keys = allowed.select(allowed_key).distinct()
    return df.join(keys, df[key] == keys[allowed_key], "left_semi")


def without_child(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    """Parents that have no child; repeated foreign keys shuffle once."""
    used = child.select(fk).distinct()
    return parent.join(used, parent[pk] == used[fk], "left_anti")


def cascade(root: DataFrame, chain: Sequence[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Rows that survive a delete, from the surviving root down a foreign-key chain.

    ``chain`` lists (table, foreign key, key of the table above).  The keys that survive on a level are
    stored, so that a level does not repeat the joins above it.
    """
    out, above = [root], root
    for table, fk, pk in chain:
        keys = above.select(F.col(pk).alias("__key")).distinct()
        keys = keys if above is root else materialize(keys, "survivors")
        above = table.join(keys, table[fk] == F.col("__key"), "left_semi")
        out.append(above)
    return out


def first_failure(df: DataFrame, rules: Mapping[str, Column], name: str = "failure") -> DataFrame:
    """Add the name of the first rule a row breaks, NULL if it breaks none.

    A rule is the condition a valid row meets; an unknown outcome breaks it.
    """
    outcome = None
    for rule, valid in rules.items():
        broken = ~F.coalesce(valid, F.lit(False))
        outcome = F.when(broken, F.lit(rule)) if outcome is None else outcome.when(broken, F.lit(rule))
    return df.withColumn(name, F.lit(None).cast("string") if outcome is None else outcome)


def violation_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """How many rows break each rule; one scan for all rules."""
    agg = df.agg(
        *[
            F.struct(F.lit(rule).alias("rule"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("violations")).alias(f"r{i}")
            for i, (rule, valid) in enumerate(rules.items())
        ]
    )
    return agg.select(F.inline(F.array(*[F.col(f"r{i}") for i in range(len(rules))])))


def invite_state(found: Column, revoked: Column, expires: Column, uses: Column, max_uses: Column, now: Column) -> Column:
    """missing, revoked, expired, exhausted or valid; the first that applies."""
    return (
        F.when(~found, F.lit("missing"))
        .when(F.coalesce(revoked, F.lit(False)), F.lit("revoked"))
        .when(now > expires, F.lit("expired"))
        .when(F.coalesce(uses, F.lit(0)) >= max_uses, F.lit("exhausted"))
        .otherwise(F.lit("valid"))
    )


def audit_unique(df: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Key values that occur more than once, with their count.

    A key with a NULL part is never a duplicate, as in a unique index.
    """
    complete = df
    for k in keys:
        complete = complete.where(F.col(k).isNotNull())
    counted = complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    return counted.withColumnRenamed("__n", count)


def audit_fk(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Foreign key values without a parent, with the number of rows that use them.

    Children are counted per value first, so a hot orphan key shuffles once.
    """
    used = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n_rows"))
    return used.join(parent, used[fk] == parent[pk], "left_anti")


def audit_nulls(df: DataFrame, required: Sequence[str] | None = None) -> DataFrame:
    """Missing values per required column; one scan."""
    cols = df.columns if required is None else list(required)
    agg = df.agg(
        *[
            F.struct(F.lit(c).alias("column"), F.count_if(F.col(f"`{c}`").isNull()).alias("n_null")).alias(f"n{i}")
            for i, c in enumerate(cols)
        ]
    )
    return agg.select(F.inline(F.array(*[F.col(f"n{i}") for i in range(len(cols))])))


def upsert(base: DataFrame, updates: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """Base rows replaced by the latest update per key, new keys appended.

    ``updates`` has the columns of ``base`` and the ordering column ``seq``.  Only
    the updates are aggregated; base rows pass through one anti join.
    """
    rest = [c for c in base.columns if c not in key]
    latest = updates.groupBy(*key).agg(F.max(F.struct(seq, *rest)).alias("__u"))
    latest = latest.select(*key, *[F.col(f"__u.{c}").alias(c) for c in rest])
    kept = base.join(latest.select(*key), list(key), "left_anti")
    return kept.select(*base.columns).unionByName(latest.select(*base.columns))


def insert_missing(base: DataFrame, incoming: DataFrame, key: str, fill: Sequence[str] = ()) -> DataFrame:
    """Insert rows only for absent keys; existing rows get missing ``fill`` values.

    Repeated incoming keys count once, with the smallest row.
    """
    rest = [c for c in base.columns if c != key]
    once = incoming.groupBy(key).agg(F.min(F.struct(*rest)).alias("__in"))
    current = base.join(once.withColumnRenamed(key, "__key"), F.col(key) == F.col("__key"), "left").select(
        key, *[F.coalesce(F.col(c), F.col(f"__in.{c}")).alias(c) if c in fill else F.col(c) for c in rest]
    )
    new = once.join(base, key, "left_anti").select(key, *[F.col(f"__in.{c}").alias(c) for c in rest])
    return current.unionByName(new)

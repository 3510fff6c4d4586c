"""Prefix trie of conversations, with totals of its subtrees by centroid decomposition.

A node is a distinct sequence of the first d turns (role and text) of some conversation; its
members are the conversations that begin with it.  A turn is digested where it is read, and a node's key
digests the running sums of position-salted turn hashes (128 bits), so no text is compared
or moved again and a conversation of any length is cut over tasks by ``operators.ordered``.

``subtree_sums`` adds values up over the subtrees of the parent-edge forest:

* A component's centroid is its deepest node with over half of the component's weight (member
  turns at or below a node), so the pieces left without it hold at most half each.
* The component's total below and at the centroid is added to every node on the path from the
  centroid to the component's top.  The centroid is then done, and its pieces are components.
* Components of more than ``SMALL`` nodes are split by joins, all at once, a written table each
  level; smaller ones are gathered whole, many to a task, and split there by the same rule in numpy.
  The bound moves work between the two and never changes a total.

So a node's total is put together from as many additions as it has levels of components, at most the
logarithm of all member turns, however deep the trie.

Turns are ordered by turn (NULL first), then role and text; equal rows are turns of their own.  A
NULL role or text is empty.  Rows without a conv_id belong to no conversation and take no part.
Without conversations there is no root and no row.  Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugeboard.llm.texts import column, text_column
from gaugeboard.operators.ordered import position_in_group, running_totals
from gaugeboard.session import materialize

#: Most nodes of a component that one task splits by itself.
SMALL = 10_000
#: Conversations whose ids are hashed as one piece of text.
CHUNK = 8_192
_SUMS = ["s0", "s1", "s2", "s3"]


def placed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position from 1, digest, size) of every turn; size: UTF-8 bytes of the text. A written table."""
    rows = conversations.select(
        column(conversations, "conv_id").cast("long").alias("conv_id"),
        column(conversations, "turn").cast("long").alias("turn"),
        F.coalesce(text_column(conversations, "role"), F.lit("")).alias("role"),
        F.coalesce(text_column(conversations, "text"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    placed = position_in_group(rows, ["conv_id"], ["turn", "role", "text"])
    return materialize(placed.select("conv_id", "position", digest.alias("digest"), F.octet_length("text").cast("long").alias("size")), "turns")


def lengths(placed: DataFrame) -> DataFrame:
    return placed.groupBy("conv_id").agg(F.max("position").alias("length"))


def respliced(placed: DataFrame, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations whose first h turns are taken from the head of their family.

    The head of c is c - c % ``family``; h is crc32(c) % (``most`` + 1).  c keeps its own turns after
    its first h.  A head with fewer turns gives all it has, an absent one none.
    """
    conv = F.col("conv_id")
    heads = lengths(placed).where(conv % family == 0).select(conv.alias("head"), F.col("length").alias("head_length"))
    h = F.crc32(conv.cast("string").cast("binary")) % (most + 1)
    convs = lengths(placed).select("conv_id", (conv - conv % family).alias("head"), h.alias("h"), F.col("length").alias("own")).join(heads, "head", "left")
    taken = F.least("h", F.coalesce("head_length", F.lit(0)))
    convs = convs.select("conv_id", "head", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    convs = materialize(convs, "convs")
    given = placed.where((conv % family == 0) & (F.col("position") <= most)).withColumnRenamed("conv_id", "head")
    first = convs.join(given, "head").where("position <= h").select("conv_id", "position", "digest", "size")
    rest = placed.join(convs.select("conv_id", "h", "taken"), "conv_id").where("position > h")
    rest = rest.select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("position"), "digest", "size")
    return first.unionByName(rest), convs.select("conv_id", "length")


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums])))


def steps(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent, size, below, last) of every prefix of every conversation, the root's included.

    ``below``: turns of the conversation from here on, one at least; ``last``: the prefix is the whole conversation.
    """
    salted = [F.xxhash64(F.lit(salt), "position", "digest") for salt in (1, 2)]
    parts = [p for s in salted for p in (F.shiftrightunsigned(s, 32), s.bitwiseAND(F.lit(0xFFFFFFFF)))]
    hashed = turns.withColumns({f"p{i}": p for i, p in enumerate(parts)})
    summed = running_totals(hashed, ["conv_id"], ["position"], {s: f"p{i}" for i, s in enumerate(_SUMS)})
    sums = [F.col(s) for s in _SUMS]
    before = [F.col(s) - F.col(f"p{i}") for i, s in enumerate(_SUMS)]
    depth = F.col("position")
    prefixes = summed.select("conv_id", depth.alias("depth"), _key(depth, sums).alias("key"), _key(depth - 1, before).alias("parent"), "size")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), _key(zero, [zero] * 4).alias("key"), F.lit(None).cast("binary").alias("parent"), zero.alias("size"))
    out = prefixes.join(convs, "conv_id").unionByName(root.join(convs, "conv_id"))
    return materialize(out.select("*", (F.col("length") - F.col("depth") + 1).alias("below"), (F.col("length") == F.col("depth")).alias("last")).drop("length"), "steps")


def nodes(steps: DataFrame) -> DataFrame:
    """One row per node: key, parent, depth, size, conv_id (least member), parent_conv_id, n_convs, n_children, weight, comp (the root's key)."""
    found = steps.groupBy("key", "parent", "depth", "size").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("below").alias("weight")
    )
    found = materialize(found, "nodes")
    above = found.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    children = found.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    out = found.join(above, "parent", "left").join(children, "key", "left")
    zero = F.lit(0).cast("long")
    return materialize(out.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "comp": _key(zero, [zero] * 4)}), "trie")


def decompose(top: np.ndarray, parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums over the subtrees inside each component, by centroid decomposition.

    ``top``: index of the component's top for each node; ``parent``: index, -1 at tops.  ``values`` has a
    row for each sum; ``weight`` falls strictly with depth along every path.
    """
    n = len(top)
    comp, weight, out = top.copy(), weight.copy(), np.zeros_like(values)
    order = np.argsort(depth, kind="stable")
    layers = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    count = np.ones(n, np.int64)
    for layer in reversed(layers):
        low = layer[parent[layer] >= 0]
        np.add.at(count, parent[low], count[low])
    start = np.zeros(n, np.int64)
    tops = np.flatnonzero(parent < 0)
    start[tops] = np.cumsum(count[tops]) - count[tops]
    for layer in layers:
        low = layer[parent[layer] >= 0]
        if not len(low):
            continue
        low = low[np.argsort(parent[low], kind="stable")]
        run = np.cumsum(count[low]) - count[low]
        first = np.flatnonzero(np.append(True, parent[low][1:] != parent[low][:-1]))
        run -= np.repeat(run[first], np.diff(np.append(first, len(low))))
        start[low] = start[parent[low]] + 1 + run
    end = start + count

    left = order  # by depth, so that of several heavy nodes the deepest is kept
    centroid = np.full(n, -1, np.int64)
    while len(left):
        own = comp[left]
        heavy = left[2 * weight[left] > weight[own]]
        centroid[comp[heavy]] = heavy
        c = centroid[own]
        inside = (start[c] <= start[left]) & (start[left] < end[c])
        above = (start[left] <= start[c]) & (start[c] < end[left])
        total = np.zeros_like(values)
        for i in range(len(values)):
            np.add.at(total[i], own[inside], values[i, left[inside]])
        out[:, left[above]] += total[:, own[above]]
        up = above & (left != c)
        weight[left[up]] -= weight[c[up]]
        down = inside & (left != c)
        kids = left[down & (parent[left] == c)]
        place = np.sort(comp[kids] * n + start[kids])
        by_start = kids[np.argsort(comp[kids] * n + start[kids], kind="stable")]
        comp[left[down]] = by_start[np.searchsorted(place, own[down] * n + start[left[down]], side="right") - 1]
        left = left[left != c]
    return out


def _whole_components(batches: Iterator[pa.RecordBatch], least: int = SMALL) -> Iterator[pa.Table]:
    """Tables of whole components, from rows in order of ``comp``."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < least:
            continue
        table = pa.concat_tables(held)
        comps = table.column("comp").to_pylist()
        cut = next((i + 1 for i in range(len(comps) - 2, -1, -1) if comps[i] != comps[-1]), 0)
        if cut:
            yield table.slice(0, cut)
        held = [table.slice(cut)]
    if held:
        yield pa.concat_tables(held)


def _local_sums(values: list[str]):
    def rows(batches):
        for table in _whole_components(batches):
            keys, comps, parents = (table.column(c).to_pylist() for c in ("key", "comp", "parent"))
            place = {k: i for i, k in enumerate(keys)}
            top = np.fromiter(map(place.__getitem__, comps), np.int64, len(keys))
            parent = np.fromiter((-1 if k == c else place[p] for k, c, p in zip(keys, comps, parents)), np.int64, len(keys))
            numbers = {c: table.column(c).to_numpy() for c in ["depth", "weight", *values, *[f"t_{v}" for v in values]]}
            sums = decompose(top, parent, numbers["depth"], numbers["weight"], np.stack([numbers[v] for v in values]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *[pa.array(numbers[f"t_{v}"] + s) for v, s in zip(values, sums)]], ["key", *values])

    return rows


def _split(state: DataFrame, steps: DataFrame, large: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """One level of the decomposition of the ``large`` components (comp, total): (centroids, done; what is left)."""
    active = state.join(large, "comp")
    node = F.struct("key", "depth", "conv_id", "weight")
    centroids = active.where(2 * F.col("weight") > F.col("total")).groupBy("comp").agg(F.max_by(node, "depth").alias("c"))
    centroids = materialize(
        centroids.select("comp", F.col("c.key").alias("c_key"), F.col("c.depth").alias("c_depth"), F.col("c.conv_id").alias("conv_id"), F.col("c.weight").alias("c_weight")),
        "centroids",
    )
    path = steps.join(centroids, "conv_id").where("depth <= c_depth").select("comp", "key", F.lit(True).alias("above"))
    below = steps.join(centroids.select("comp", F.col("c_key").alias("parent")), "parent").select("comp", "conv_id", F.col("key").alias("child"))
    marked = active.drop("total").join(centroids.drop("conv_id"), "comp").join(path, ["comp", "key"], "left").join(below, ["comp", "conv_id"], "left")
    is_centroid, down = F.col("key") == F.col("c_key"), F.col("child").isNotNull() & (F.col("depth") > F.col("c_depth"))
    marked = materialize(marked.withColumns({"down": down, "done": is_centroid}).drop("c_key", "c_depth"), "marked")
    added = marked.where("down OR done").groupBy("comp").agg(*[F.sum(v).alias(f"a_{v}") for v in values])
    summed = marked.join(added, "comp").withColumns(
        {f"t_{v}": F.when(F.col("above"), F.col(f"t_{v}") + F.col(f"a_{v}")).otherwise(F.col(f"t_{v}")) for v in values}
        | {"weight": F.when(F.col("above"), F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")), "comp": F.when(F.col("down"), F.col("child")).otherwise(F.col("comp"))}
    )
    summed = materialize(summed.select(*state.columns, "done"), "split")
    return summed.where("done").drop("done"), summed.where("NOT done").drop("done")


def subtree_sums(nodes: DataFrame, steps: DataFrame, values: list[str], small: int | None = None) -> DataFrame:
    """(key, sum of each value over the node's subtree).

    ``nodes`` has key, parent, comp (key of its tree's top), depth, conv_id (a conversation through the node),
    weight (at a node larger than at all its children together) and the long values; ``steps`` has the nodes
    along each of these conversations (conv_id, depth, key, parent).
    """
    small = SMALL if small is None else small
    totals = [f"t_{v}" for v in values]
    state = nodes.select("comp", "key", "parent", "depth", "conv_id", "weight", *values, *[F.lit(0).cast("long").alias(t) for t in totals])
    finished = []
    while True:
        sizes = state.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("total"))
        large = materialize(sizes.where(F.col("n") > small).select("comp", "total"), "large")
        if large.isEmpty():
            break
        rest = state.join(large, "comp", "left_anti")
        done, left = _split(state, steps, large, values)
        finished.append(done)
        state = rest.unionByName(left)
    fields = ", ".join(f"{v} long" for v in values)
    near = state.select("comp", "key", "parent", "depth", "weight", *values, *totals).repartition("comp").sortWithinPartitions("comp")
    out = near.mapInArrow(_local_sums(values), f"key binary, {fields}")
    for done in finished:
        out = out.unionByName(done.select("key", *[F.col(t).alias(v) for t, v in zip(totals, values)]))
    return out


def _id_chunks(batches):
    """(key, first, ids) of runs of sorted rows (key, conv_id): ids as text, comma-joined, ``CHUNK`` at most."""
    key, held, out = None, [], []

    def flush():
        if held:
            out.append((key, held[0], ",".join(map(str, held))))

    for batch in batches:
        for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key or len(held) == CHUNK:
                flush()
                key, held = k, []
            held.append(conv)
        if out:
            yield _chunk_batch(out)
            out = []
    flush()
    if out:
        yield _chunk_batch(out)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["key", "first", "ids"]
    )


def _chunk_hashes(batches):
    """(key, SHA-256) of the chunks of each key, in order; the text of a key is never held whole."""
    key, digest = None, None
    for batch in batches:
        found = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k != key:
                if key is not None:
                    found.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if found:
            yield _hash_batch(found)
    if key is not None:
        yield _hash_batch([(key, digest.hexdigest())])


def _hash_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["key", "ends_sha256"])


def ends(steps: DataFrame) -> DataFrame:
    """(key, ends_sha256): digest of the ids of the conversations that end in the node.

    Ids are put in order and written out by range, so that a node where most conversations end is shared
    among tasks; a digest runs in sequence, so only ready text passes through the node's one task.
    """
    last = steps.where("last").select("key", "conv_id")
    chunks = last.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_id_chunks, "key binary, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_chunk_hashes, "key binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, small: int | None = None) -> DataFrame:
    """One row per node of the prefix trie of placed ``turns``; ``convs`` (conv_id, length) also lists those without turns.

    conv_id (least member), depth, parent_conv_id (that of the parent), n_convs, n_children, n_leaves
    (childless nodes of the subtree), saved_tokens (bytes of text that members beyond the first repeat, over
    the subtree) and ends_sha256 (of the ids of members that end here, ascending, comma-joined).
    """
    walked = steps(turns, convs)
    found = nodes(walked).withColumns(
        {"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("size")}
    )
    sums = subtree_sums(found, walked, ["n_leaves", "saved_tokens"], small)
    out = found.drop("n_leaves", "saved_tokens").join(sums, "key").join(ends(walked), "key", "left")
    nothing = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", nothing.alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, small: int | None = None) -> DataFrame:
    """The trie of the conversations as they are."""
    placed = placed_turns(conversations)
    return trie(placed, lengths(placed), small)


def respliced_trie(conversations: DataFrame, small: int | None = None) -> DataFrame:
    """The trie of the conversations that begin like the head of their family (``respliced``)."""
    return trie(*respliced(placed_turns(conversations)), small)

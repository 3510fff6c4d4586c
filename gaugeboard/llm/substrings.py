"""Passages that an earlier document already has: relative Lempel-Ziv parsing over the corpus.

The reference is the corpus itself, cut into blocks: a reference block indexes the first
document of every window of LENGTH words whose hash falls into it.  Each document is parsed
against all blocks.  Its windows name the blocks that can match; a factor starts at a window
that begins in an earlier document and goes on greedily while the following windows come from
that document too.  Windows across a factor's boundary are looked up like all others, so every
position starts its own check and no match of LENGTH words or more is missed.  Factors are at
least LENGTH words long by construction, and each is a duplicate span.

Most windows are unique, so a cheaper question comes first.  The least hash of the six-word
grams inside a window is its anchor; equal windows have equal anchors, and an anchor serves
some five windows.  Only windows whose anchor occurs in two documents are sent to the
reference blocks, once per block of documents, with 96-bit hashes.

A document without an id is left whole and is nobody's reference.  NULL and short texts have
no windows.  Rows of one id count as one document; their words count row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from gaugeboard.llm.packing import block_count, in_blocks, pack, split, unpack
from gaugeboard.llm.texts import Words, column, covered, mixed, pieces, row_beside_text, row_with_text, text_column, window_hashes, window_starts

LENGTH = 13
GRAM = 6
ASKED = "bucket int, block int, payload binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        ["bucket", "block", "payload"],
    )


def _field(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = _field(batch, "doc_id")
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)


class Windows:
    """Windows of the texts of a piece that have an id."""

    def __init__(self, batch: pa.RecordBatch, texts: list[bytes]):
        ids, known = _ids(batch)
        self.words = Words([t if k else b"" for t, k in zip(texts, known)])
        self.hashes = self.words.hashes()
        self.starts = window_starts(self.words.first, LENGTH)
        self.docs = ids[self.words.doc[self.starts]]

    def anchors(self) -> np.ndarray:
        least, width = window_hashes(self.hashes, GRAM), 1
        while width < LENGTH - GRAM + 1:
            step = min(width, LENGTH - GRAM + 1 - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        return least[self.starts] if len(self.starts) else np.zeros(0, np.uint64)

    def keys(self, chosen=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        first = window_hashes(self.hashes, LENGTH)[self.starts[chosen]]
        second = window_hashes(self.hashes ^ np.uint64(0x5BD1E9955BD1E995), LENGTH, 0xDA942042E4DD58B5)[self.starts[chosen]]
        return first, (second >> np.uint64(32)).astype(np.uint32)


def _grouped(keys: tuple[np.ndarray, ...], low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Distinct sorted keys with the least ``low`` and the largest ``high`` of each."""
    if not len(low):
        return [*keys, low, high]
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys, low, high = tuple(k[order] for k in keys), low[order], high[order]
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
    at = np.flatnonzero(new)
    return [*(k[at] for k in keys), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)]


def _together(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    columns = [np.concatenate(c) for c in zip(*parts)]
    return _grouped(tuple(columns[:-2]), columns[-2], columns[-1])


def _buckets(keys: np.ndarray, count: int) -> np.ndarray:
    return (mixed(keys) >> np.uint64(33)).astype(np.int64) % count


def _ask_anchors(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct anchors of a block, with whether two of its documents have them."""
        parts, block = [], 0
        for batch, texts in pieces(batches):
            block = _field(batch, "block")[0].as_py()
            w = Windows(batch, texts)
            anchors = w.anchors()
            if len(anchors):
                run = np.append(True, (anchors[1:] != anchors[:-1]) | (w.docs[1:] != w.docs[:-1]))
                parts.append(_grouped((anchors[run],), w.docs[run], w.docs[run]))
        if parts:
            keys, low, high = _together(parts)
            several = (low != high).astype(np.uint8)
            rows = [(b, block, pack(keys[at], several[at])) for b, at in split(_buckets(keys, buckets), buckets)]
            for i in range(0, len(rows), 64):
                yield _rows(rows[i : i + 64])

    return ask


def _answer_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each block, those of its anchors that several documents have."""
    asked = [(b, who, unpack(p)) for batch in batches for b, who, p in zip(*(_field(batch, c).to_pylist() for c in ("bucket", "block", "payload")))]
    keys = np.sort(np.concatenate([k for _, _, (k, _) in asked]))
    again = keys[1:][keys[1:] == keys[:-1]]
    shared = np.unique(np.concatenate([again, *(k[s > 0] for _, _, (k, s) in asked)]))
    for b, who, (mine, _) in asked:
        mine = mine[np.isin(mine, shared, assume_unique=True)]
        if len(mine):
            yield _rows([(b, who, pack(mine))])


def _ask_windows(buckets: int):
    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """Distinct windows with shared anchors of a block: hashes, first document, whether there is another."""
        shared = [unpack(p)[0] for p in answers.column("payload").to_pylist()]
        parts = []
        if shared and docs.num_rows:
            shared = np.sort(np.concatenate(shared))
            for batch, texts in pieces(docs.to_batches()):
                w = Windows(batch, texts)
                anchors = w.anchors()
                if not len(anchors):
                    continue
                run = np.append(True, anchors[1:] != anchors[:-1])
                at = np.searchsorted(shared, anchors[run])
                at[at == len(shared)] = 0
                chosen = np.flatnonzero((shared[at] == anchors[run])[np.cumsum(run) - 1])
                if len(chosen):
                    parts.append(_grouped(w.keys(chosen), w.docs[chosen], w.docs[chosen]))
        rows = []
        if parts:
            block = docs.column("block")[0].as_py()
            first, second, low, high = _together(parts)
            several = (low != high).astype(np.uint8)
            rows = [(b, block, pack(first[at], second[at], low[at], several[at])) for b, at in split(_buckets(first, buckets), buckets)]
        return pa.Table.from_batches([_rows(rows)])

    return ask


def _answer_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each block, the first document of those of its windows that an earlier document has."""
    asked = [(b, who, unpack(p)) for batch in batches for b, who, p in zip(*(_field(batch, c).to_pylist() for c in ("bucket", "block", "payload")))]
    first, second, low, _ = (np.concatenate(c) for c in zip(*(p for *_, p in asked)))
    order = np.lexsort((second, first))
    new = np.append(True, (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1]))
    least = np.empty(len(first), np.int64)
    least[order] = np.minimum.reduceat(low[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    begin = 0
    for b, who, (mine, check, own, several) in asked:
        found = least[begin : begin + len(mine)]
        begin += len(mine)
        keep = (found < own) | (several > 0)
        if keep.any():
            yield _rows([(b, who, pack(mine[keep], check[keep], found[keep]))])


def _references(w: Windows, index: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each window the earlier document it starts in, its own where there is none."""
    first, second, docs = index
    out = w.docs.copy()
    if not len(first) or not len(out):
        return out
    mine, check = w.keys()
    at = np.searchsorted(first, mine)
    left = np.arange(len(mine))
    while len(left):
        left = left[at[left] < len(first)]
        left = left[first[at[left]] == mine[left]]
        right = second[at[left]] == check[left]
        hit = left[right]
        out[hit] = np.minimum(out[hit], docs[at[hit]])
        left = left[~right]
        at[left] += 1
    return out


def factors(w: Windows, references: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of a piece: first word, last word + 1 and reference document of each."""
    hit = np.flatnonzero(references < w.docs)
    if not len(hit):
        return hit, hit, references[hit]
    begins, source = w.starts[hit], references[hit]
    new = np.append(True, (begins[1:] != begins[:-1] + 1) | (source[1:] != source[:-1]))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(hit)) - 1
    return begins[at], begins[last] + LENGTH, source[at]


def _parse(schema: pa.Schema):
    def parse(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        parts = [unpack(p) for p in answers.column("payload").to_pylist()]
        index = tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.uint64),) * 3
        if parts:
            order = np.argsort(index[0], kind="stable")
            index = tuple(c[order] for c in index)
        for batch, texts in pieces(docs.to_batches()) if docs.num_rows else ():
            w = Windows(batch, texts)
            begins, ends, source = factors(w, _references(w, index))
            gone = np.zeros(len(w.hashes) + 1, np.int32)
            np.add.at(gone, begins, 1)
            np.add.at(gone, ends, -1)
            gone = np.cumsum(gone[:-1]) > 0
            _, known = _ids(batch)
            hit = np.unique(w.words.doc[begins]) if len(begins) else ()
            owner = w.words.doc[begins]
            columns = {name: _field(batch, name) for name in schema.names if name in ("row", "doc_id")}
            counts, removed, kept_text, spans = w.words.counts.tolist(), [0] * len(texts), list(texts), [None] * len(texts)
            for i in np.flatnonzero(~known):
                counts[i] = len(texts[i].split())
            starts, edges = w.words.starts, np.cumsum([1] + [len(t if k else b"") + 1 for t, k in zip(texts, known)])
            for i in hit:
                a, z = w.words.first[i], w.words.first[i + 1]
                lost = gone[a:z]
                removed[i] = int(lost.sum())
                change = np.flatnonzero(np.diff(np.concatenate(([0], lost.astype(np.int8), [0]))))
                bounds = np.append(starts[a:z], edges[i] + len(texts[i])) - edges[i]
                cuts = bounds[change].tolist()
                kept_text[i] = b"".join(texts[i][x:y] for x, y in zip([0, *cuts[1::2]], [*cuts[::2], len(texts[i])]))
                mine = owner == i
                spans[i] = [{"first": int(x - a), "last": int(y - a), "reference": int(s)} for x, y, s in zip(begins[mine], ends[mine], source[mine])]
            columns |= {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
            if "spans" in schema.names:
                columns["spans"] = pa.array(spans, schema.field("spans").type)
            if "kept" in schema.names:
                missing = _field(batch, "text").is_null().to_numpy(zero_copy_only=False)
                columns["kept"] = pa.array(kept_text, pa.binary(), mask=missing).cast(pa.string())
            if "kept_sha256" in schema.names:
                columns["kept_sha256"] = pa.array([hashlib.sha256(b" ".join(t.split())).hexdigest() for t in kept_text])
            out.append(pa.table([columns[n] for n in schema.names], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return parse


SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first", "last", "reference")]))


def parsed(docs: DataFrame, outputs: dict[str, T.DataType], id_col="doc_id", text_col="text", rows: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and ``outputs`` (kept, kept_sha256, spans) per row; with ``rows`` the row beside the text too."""
    doc_id, text = column(docs, id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text")
    count = block_count(docs, text)
    plain = in_blocks(docs, [doc_id, text], [doc_id, text], count)
    full = in_blocks(docs, [doc_id, text, row_beside_text(docs, text_col)[0].alias("row")], [doc_id, text], count) if rows else plain
    by_block = plain.groupBy("block")
    anchors = by_block.applyInArrow(_ask_anchors(count), ASKED).groupBy("bucket").applyInArrow(_answer_anchors, ASKED)
    asked = by_block.cogroup(anchors.groupBy("block")).applyInArrow(_ask_windows(count), ASKED)
    answers = asked.groupBy("bucket").applyInArrow(_answer_windows, ASKED)
    fields = [("row", full.schema["row"].dataType)] if rows else []
    fields += [("doc_id", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), *outputs.items()]
    arrow = pa.schema([pa.field(n, to_arrow_type(t)) for n, t in fields])
    return full.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_parse(arrow), T.StructType([T.StructField(n, t) for n, t in fields]))


def digests(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by single spaces) per row."""
    return parsed(docs, {"kept_sha256": T.StringType()}, id_col, text_col)


def spans(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Duplicate spans, as words [first, last) of a document with the earlier document."""
    found = parsed(docs, {"spans": SPANS}, id_col, text_col)
    return found.select("doc_id", F.explode("spans").alias("span")).select("doc_id", "span.*")


def without_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows, their duplicate spans cut out of the text; the length column follows."""
    found = parsed(docs, {"kept": T.StringType()}, id_col, text_col, rows=True)
    cut = F.col("n_removed") > 0
    replaced = {}
    if text_col in docs.columns and docs.schema[text_col].dataType.typeName() != "string":
        replaced[text_col] = F.when(cut, F.col("kept")).otherwise(F.col("row").getField(text_col))
    if length_col in docs.columns:
        replaced[length_col] = F.when(cut, F.char_length("kept").cast(docs.schema[length_col].dataType)).otherwise(F.col("row").getField(length_col))
    whole = dict(zip(docs.columns, row_with_text(docs, text_col, text="kept")))
    return found.select(*[replaced[c].alias(c) if c in replaced else whole[c] for c in docs.columns])

"""Benchmark passages in documents, found with an FM-index per shard of the documents.

Every task indexes its documents shard by shard (some megabytes of text): the suffix array of
the shard's words gives the Burrows-Wheeler transform, kept as a wavelet matrix with rank counts.
All windows of the benchmark are searched backwards at once; occurrences are located by walking
to a sampled suffix position, mapped to words of documents and merged to removal spans.  Words
that no benchmark item has are one separator symbol, and runs too short for any window are left
out of the index, since no window can lie there.

The benchmark is read in blocks of at most BLOCK_BYTES of text.  One block is searched as the
documents are read, without a shuffle; of more, each is searched in a pass of its own and only
the hits are kept, so what is held and broadcast stays bounded.

NULL and word-free texts have no words and no hits; NULL or word-free items have no window.  Items
without id count as item "".  Each row of repeated documents is judged alike; extra columns are
not read.  An item in several rows is one item with all their windows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gaugeboard.llm.texts import column, pieces, row_beside_text, row_with_text, text_column
from gaugeboard.session import materialize

WINDOW = 13
BLOCK_BYTES = 4_000_000
#: A document is contaminated if a twentieth of its words or more are hit.
SHARE = 20
#: Every so many text positions one suffix-array entry is kept.
SAMPLE = 8
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
HITS = "array<struct<first:int,last:int,item:string>>"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: ASCII letters and digits and all characters beyond ASCII."""
    return text.translate(_TABLE).split()


class Phrases:
    """The windows of a block of benchmark items, as symbols of the items' words."""

    def __init__(self, items: list[tuple[str, bytes]], length: int = WINDOW):
        self.symbols: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.symbols.setdefault(w, len(self.symbols) + 2) for w in words_of(text)]
            for i in range(max(1, len(ids) - length + 1)) if ids else ():
                windows[tuple(ids[i : i + length])].add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for size in {len(w) for w in windows}:
            chosen = [w for w in windows if len(w) == size]
            self.by_length[size] = (np.array(chosen, np.int64), [sorted(windows[w]) for w in chosen])
        self.shortest = min(self.by_length, default=0)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling the length that ranks compare."""
    n, step = len(symbols), 1
    rank = symbols.astype(np.int64)
    while True:
        following = np.zeros(n, np.int64)
        following[: n - step] = rank[step:] + 1
        key = rank * (max(int(rank.max()), n) + 2) + following
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
        step *= 2
        if step >= n or rank[order[-1]] == n - 1:
            return order


class FMIndex:
    """Backward search and location over symbols >= 1; a 0 is added as the end."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        text = np.append(symbols, 0)
        suffixes = suffix_array(text)
        last = text[suffixes - 1]
        self.levels = max(1, int(text.max()).bit_length())
        self.before = np.cumsum(np.append(0, np.bincount(text, minlength=1 << self.levels)))
        self.ones, self.zeros, row = [], [], last
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            self.ones.append(np.cumsum(np.append(0, bit), dtype=np.int32))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            row = np.concatenate([row[~bit], row[bit]])
        self.bottom = np.searchsorted(self._key(row), self._key(np.arange(1 << self.levels)))
        kept = suffixes % sample == 0
        self.sampled, self.positions = np.cumsum(np.append(0, kept), dtype=np.int32), suffixes[kept]

    def _key(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols in the order of the matrix's last row: by their bits read backwards."""
        out = np.zeros(len(symbols), np.int64)
        for level in range(self.levels):
            out = out << 1 | symbols >> level & 1
        return out

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first ``at`` of the transform."""
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbols >> (self.levels - 1 - level) & 1).astype(bool)
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return at - self.bottom[symbols]

    def step(self, at: np.ndarray) -> np.ndarray:
        """From the row of a suffix to that of the suffix one longer."""
        symbols = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] - ones[at]
            symbols = symbols << 1 | bit
            at = np.where(bit > 0, zeros + ones[at], at - ones[at])
        return self.before[symbols] + at - self.bottom[symbols]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For phrases of one length: the number of each that occurs, and its range of rows."""
        size = len(self.ones[0]) - 1
        alive = np.flatnonzero((phrases < 1 << self.levels).all(axis=1))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), size, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbols = phrases[alive, j]
            low, high = (self.before[symbols] + self.rank(symbols, x) for x in (low, high))
            keep = high > low
            alive, low, high = alive[keep], low[keep], high[keep]
        return alive, np.stack([low, high], axis=1)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows."""
        out, moved, at, left = np.empty(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(left):
            known = self.sampled[at + 1] > self.sampled[at]
            out[left[known]] = self.positions[self.sampled[at[known]]] + moved
            left, at = left[~known], self.step(at[~known])
            moved += 1
        return out


def shard_hits(texts: list[list[bytes]], phrases: Phrases) -> dict[int, list[tuple[int, int, str]]]:
    """Merged spans of each item's occurrences, as words [first, last), by document of the shard."""
    known = phrases.symbols
    ids = np.fromiter((known.get(w, 1) for words in texts for w in [*words, b""]), np.int64)
    if not phrases.by_length or not len(ids):
        return {}
    inside = np.diff(np.concatenate(([0], (ids > 1).astype(np.int8), [0])))
    begins, ends = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    long = ends - begins >= phrases.shortest
    begins, ends = begins[long], ends[long] + 1  # the separator after a run stays with it
    if not len(begins):
        return {}
    sizes = ends - begins
    origin = np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    index = FMIndex(ids[origin])
    first = np.cumsum([0, *(len(words) + 1 for words in texts)])
    spans: dict[int, list] = defaultdict(list)
    for length, (windows, items) in phrases.by_length.items():
        which, rows = index.search(windows)
        counts = rows[:, 1] - rows[:, 0]
        every = np.arange(counts.sum()) + np.repeat(rows[:, 0] - (np.cumsum(counts) - counts), counts)
        places = origin[index.locate(every)]
        docs = np.searchsorted(first, places, side="right") - 1
        for doc, begin, window in zip(docs.tolist(), (places - first[docs]).tolist(), np.repeat(which, counts).tolist()):
            for item in items[window]:
                spans[doc].append((item, begin, begin + length))
    return {doc: merged(found) for doc, found in spans.items()}


def merged(found: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    out: list[list] = []
    for item, begin, end in sorted(found):
        if out and out[-1][2] == item and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end, item])
    return [tuple(x) for x in out]


def _search(block):
    def search(batches):
        phrases = block.value
        for batch, texts in pieces(batches):
            found = [words_of(t) for t in texts]
            hits = batch.column(batch.schema.get_field_index("hits")).to_pylist()
            for doc, spans in shard_hits(found, phrases).items():
                hits[doc] = (hits[doc] or []) + [{"first": a, "last": z, "item": i} for a, z, i in spans]
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            columns["n_words"] = pa.array(list(map(len, found)), pa.int64())
            columns["hits"] = pa.array(hits, batch.schema.field("hits").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return search


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str):
    """The items, in blocks of bounded size; at least one block, if empty."""
    item, text = F.coalesce(column(benchmark, item_col).cast("string"), F.lit("")).alias("item"), text_column(benchmark, text_col).alias("text")
    items = benchmark.select(item, text).filter(F.length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    count = max(1, -(-total // BLOCK_BYTES))
    for i in range(count):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == i) if count > 1 else items
        yield Phrases([(r["item"], r["text"].encode()) for r in part.toLocalIterator()])


def _judged(hits: list | None, n: int) -> tuple[int, int, str, bool]:
    items = sorted({h["item"] for h in hits or ()})
    covered = end = 0
    for first, last in sorted((h["first"], h["last"]) for h in hits or ()):
        covered += max(0, last - max(first, end))
        end = max(end, last)
    return covered, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), covered > 0 and SHARE * covered >= n


def _judge(without: tuple[str, ...], batches):
    for batch in batches:
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in without}
        hits, words = columns.pop("hits").to_pylist(), columns["n_words"].to_pylist()
        n_hit, n_items, sha, bad = zip(*map(_judged, hits, words)) if len(hits) else ((),) * 4
        columns |= {"n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array(n_items, pa.int64()), "items_sha256": pa.array(sha, pa.string()), "contaminated": pa.array(bad, pa.bool_())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def hits(rows: DataFrame, benchmark: DataFrame, item_col="item_id", text_col="text") -> DataFrame:
    """``rows`` (with ``text``) and n_words and ``hits``: each item's merged spans of words.

    A benchmark of one block is matched as the rows are read.  With more, each block is a pass over the texts that
    stores the few texts with hits by their digest, and the hits of all blocks are joined to the rows in the end: only
    two blocks are held at a time, and the plan of the result has one evaluation in Python however many there were.
    """
    context = rows.sparkSession.sparkContext
    blocks = blocks_of(benchmark, item_col, text_col)
    block, later = next(blocks), next(blocks, None)
    if later is None:
        return _matched(rows, F.lit(None).cast(HITS), context.broadcast(block))
    key = F.md5(F.coalesce("text", F.lit("")))
    texts, parts = rows.select(key.alias("key"), "text"), []
    for phrases in itertools.chain([block, later], blocks):
        shared = context.broadcast(phrases)
        found = _matched(texts, F.lit(None).cast(HITS), shared).where("hits IS NOT NULL")
        parts.append(materialize(found.select("key", "hits").dropDuplicates(["key"]), "hits"))  # equal texts have equal hits
        shared.destroy()
    together = functools.reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.flatten(F.collect_list("hits")).alias("found"))
    held = rows.withColumn("key", key).join(together, "key", "left").drop("key")
    return _matched(held, F.col("found"), context.broadcast(Phrases([]))).drop("found")


def _matched(rows: DataFrame, known: Column, shared) -> DataFrame:
    """``rows``, n_words and the ``known`` hits with those of a block."""
    found = rows.withColumn("n_words", F.lit(0).cast("long")).withColumn("hits", known)
    return found.mapInArrow(_search(shared), T.StructType([T.StructField(f.name, f.dataType) for f in found.schema]))


def _judged_rows(rows: DataFrame, benchmark: DataFrame, without: tuple[str, ...] = ("text",)) -> DataFrame:
    found = hits(rows, benchmark)
    kept = [T.StructField(f.name, f.dataType) for f in found.schema if f.name not in (*without, "hits")]
    new = [("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())]
    return found.mapInArrow(functools.partial(_judge, without), T.StructType([*kept, *[T.StructField(n, t) for n, t in new]]))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per row."""
    doc_id = column(docs, id_col)
    doc_id = doc_id if id_col in docs.columns else doc_id.cast("long")
    return _judged_rows(docs.select(doc_id.alias("doc_id"), text_column(docs, text_col).alias("text")), benchmark)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col="text") -> DataFrame:
    """The rows that are not contaminated, unchanged."""
    row, text = row_beside_text(docs, text_col)
    found = _judged_rows(docs.select(row.alias("row"), text.alias("text")), benchmark, without=())
    return found.filter(~F.col("contaminated")).select(*row_with_text(docs, text_col))

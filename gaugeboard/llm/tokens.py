"""Token counts that follow edits: a segment tree of pre-tokens per document.

A text is cut into pre-tokens by the tokenizer's pattern; each has its number of tokens.  The
leaves of a document's tree hold some pre-tokens each, its inner nodes the sums of characters and
tokens below.  An edit descends to the leaves it touches and re-encodes from a pre-token some
characters before it (a match looks a few characters ahead) until the new cuts fall on old ones
again; from there on nothing can change, as the pattern looks only to the right.  Then the sums on the
paths of these leaves are brought up to date; no other leaf is read.

A NULL text is empty and has no tokens.  Edits are character ranges of the text before any edit;
one that overlaps an earlier-starting one, or lies outside the text, is not applied.  Edits of equal start
apply in order of their end and replacement.  Equal rows get equal results; rows of one id share
its edits.  Extra columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gaugeboard.llm.packing import pack, unpack
from gaugeboard.llm.texts import column, pieces, text_column

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that belongs to the ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
#: Characters before an edit from which on cuts may change.
CONTEXT = 4
KEPT_PIECES = 400_000
Edit = tuple[int, int, str]


class Tokenizer:
    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern, self.sizes = regex.compile(pattern), {}

    def size(self, piece: str) -> int:
        """Tokens of one pre-token."""
        found = self.sizes.get(piece)
        if found is None:
            if len(self.sizes) >= KEPT_PIECES:
                self.sizes.clear()
            found = self.sizes[piece] = len(self.encoding._encode_single_piece(piece.encode()))
        return found

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)


class TokenTree:
    """Sums over leaves of pre-tokens; node 1 is the root, node i has children 2i and 2i + 1."""

    def __init__(self, tokenizer: Tokenizer, leaves: list[list[str]], sizes: list[list[int]] | None = None):
        self.tokenizer, self.leaves = tokenizer, leaves or [[]]
        self.sizes = sizes or [list(map(tokenizer.size, leaf)) for leaf in self.leaves]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        n = len(self.leaves)
        self.chars[self.width : self.width + n] = [sum(map(len, leaf)) for leaf in self.leaves]
        self.tokens[self.width : self.width + n] = [sum(s) for s in self.sizes]
        step = self.width
        while step > 1:
            for sums in (self.chars, self.tokens):
                sums[step // 2 : step] = sums[step : 2 * step].reshape(-1, 2).sum(axis=1)
            step //= 2
        self.encoded = 0  # pre-tokens encoded anew by edits

    @classmethod
    def of(cls, tokenizer: Tokenizer, text: str) -> TokenTree:
        found = tokenizer.pieces(text)
        return cls(tokenizer, [found[i : i + LEAF] for i in range(0, len(found), LEAF)])

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def packed(self) -> bytes:
        """Characters and tokens of every pre-token."""
        lengths = np.fromiter((len(p) for leaf in self.leaves for p in leaf), np.uint32)
        return pack(lengths, np.fromiter((s for sizes in self.sizes for s in sizes), np.uint32, len(lengths)))

    @classmethod
    def unpacked(cls, tokenizer: Tokenizer, text: str, packed: bytes) -> TokenTree:
        """The tree of a text whose pre-tokens were packed; nothing is encoded."""
        lengths, sizes = unpack(packed)
        ends = np.cumsum(lengths).tolist()
        found, sizes = [text[a:z] for a, z in zip([0, *ends], ends)], sizes.tolist()
        spans = range(0, len(found), LEAF)
        return cls(tokenizer, [found[i : i + LEAF] for i in spans], [sizes[i : i + LEAF] for i in spans] or None)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf with character ``place``, and where the leaf begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if place >= begin + self.chars[node] and self.chars[node + 1] > 0:
                begin += int(self.chars[node])
                node += 1
        return node - self.width, begin

    def _refresh(self, leaf: int) -> None:
        node = self.width + leaf
        self.chars[node], self.tokens[node] = sum(map(len, self.leaves[leaf])), sum(self.sizes[leaf])
        while node > 1:
            node //= 2
            for sums in (self.chars, self.tokens):
                sums[node] = sums[2 * node] + sums[2 * node + 1]

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace characters [start, end), re-encoding only around them."""
        first, begin = self._leaf_at(max(0, start - CONTEXT))
        while first and begin > start - CONTEXT:
            first, begin = self._leaf_at(begin - 1)
        last, at = first, begin + int(self.chars[self.width + first])
        keep, place = 0, begin
        while keep < len(self.leaves[first]) and place + len(self.leaves[first][keep]) + CONTEXT <= start:
            place += len(self.leaves[first][keep])
            keep += 1
        old = list(zip(self.leaves[first][keep:], self.sizes[first][keep:]))
        while True:
            while at < end and last + 1 < len(self.leaves):
                last += 1
                old += zip(self.leaves[last], self.sizes[last])
                at += int(self.chars[self.width + last])
            before = "".join(p for p, _ in old)
            after = before[: start - place] + replacement + before[end - place :]
            shift = len(replacement) - (end - start)
            cuts, spot = {}, place
            for i, (piece, _) in enumerate(old):
                if spot >= end:
                    cuts[spot + shift] = i
                spot += len(piece)
            whole = last + 1 >= len(self.leaves)
            new, spot, rest = [], place, len(old)
            for found in self.tokenizer.pattern.finditer(after):
                if spot in cuts:
                    rest = cuts[spot]
                    break
                # The last match may go on in the next leaf.
                if found.end() + CONTEXT > len(after) and not whole:
                    rest = None
                    break
                new.append(found[0])
                spot += len(found[0])
            if rest is not None and (whole or rest < len(old)):
                break
            last += 1
            old += zip(self.leaves[last], self.sizes[last])
            at += int(self.chars[self.width + last])
        self.encoded += len(new)
        sizes = list(map(self.tokenizer.size, new))
        self.leaves[first] = [*self.leaves[first][:keep], *new, *(p for p, _ in old[rest:])]
        self.sizes[first] = [*self.sizes[first][:keep], *sizes, *(s for _, s in old[rest:])]
        for leaf in range(first + 1, last + 1):
            self.leaves[leaf], self.sizes[leaf] = [], []
        for leaf in range(first, last + 1):
            self._refresh(leaf)

    def apply(self, edits: list[Edit]) -> int:
        """Apply the usable edits, last first so that places stay valid; their number."""
        chosen, reach, n = [], 0, int(self.chars[1])
        for start, end, text in sorted(edits):
            if reach <= start <= end <= n:
                chosen.append((start, end, text))
                reach = max(end, start + 1)
        for start, end, text in reversed(chosen):
            self.edit(start, end, text)
        return len(chosen)


def ranks_of(spark: SparkSession, path: str):
    """The vocabulary file, read where it lies and broadcast; its size is that of a vocabulary."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


#: Personal data, as the query's edits: mail addresses and long runs of digits.
_REDACTED = regex.compile(r"[A-Za-z0-9._+-]{1,64}+@[A-Za-z0-9.-]{1,255}+|[0-9]{4,}+")


def redactions(text: str) -> list[Edit]:
    return [(m.start(), m.end(), "[redacted]") for m in _REDACTED.finditer(text)]


def _counts(ranks, edits_of: Callable[[str], list[Edit]] | None, pattern: str):
    def counts(batches: Iterator[pa.RecordBatch]):
        tokenizer = Tokenizer(ranks.value, pattern)
        for batch, texts in pieces(batches):
            given = None if edits_of else batch.column(batch.schema.get_field_index("edits")).to_pylist()
            packed = batch.column(batch.schema.get_field_index("tree")).to_pylist() if "tree" in batch.schema.names else [None] * len(texts)
            rows = []
            for i, (raw, tree) in enumerate(zip(texts, packed)):
                text = raw.decode()
                known = TokenTree.unpacked(tokenizer, text, tree) if tree else TokenTree.of(tokenizer, text)
                edits = edits_of(text) if edits_of else [(e["start"], e["end"], e["text"] or "") for e in given[i] or () if e["start"] is not None and e["end"] is not None]
                before, pre = known.total, sum(map(len, known.leaves))
                n = known.apply(edits)
                rows.append((pre, before, n, known.encoded, known.total))
            columns = [batch.column(batch.schema.get_field_index("doc_id")), *[pa.array(c, pa.int64()) for c in zip(*rows)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS])

    return counts


COUNTS = ["n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after"]


def _schema(rows: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *[T.StructField(n, T.LongType()) for n in COUNTS]])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id = column(docs, id_col)
    doc_id = doc_id if id_col in docs.columns else doc_id.cast("long")
    return docs.select(doc_id.alias("doc_id"), text_column(docs, text_col).alias("text"))


def counts(docs: DataFrame, edits_of: Callable[[str], list[Edit]] = redactions, id_col="doc_id", text_col="text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Tokens of every text before and after the edits that a function finds in it."""
    rows = _texts(docs, id_col, text_col)
    return rows.mapInArrow(_counts(ranks_of(docs.sparkSession, ranks), edits_of, pattern), _schema(rows))


def trees(docs: DataFrame, id_col="doc_id", text_col="text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, text and the packed ``tree`` of every row, to be stored and edited later."""
    rows, shared = _texts(docs, id_col, text_col), ranks_of(docs.sparkSession, ranks)

    def build(batches):
        tokenizer = Tokenizer(shared.value, pattern)
        for batch, texts in pieces(batches):
            built = [TokenTree.of(tokenizer, t.decode()).packed() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(built, pa.binary())], ["doc_id", "text", "tree"])

    return rows.mapInArrow(build, T.StructType([*rows.schema.fields, T.StructField("tree", T.BinaryType())]))


def recounted(stored: DataFrame, edits: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Counts of stored ``trees`` after a table of edits (doc_id, start, end, text)."""
    edit = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("text").cast("string").alias("text"))
    per_doc = edits.groupBy(F.col("doc_id").alias("edited")).agg(F.collect_list(edit).alias("edits"))
    rows = stored.join(per_doc, F.col("doc_id") == F.col("edited"), "left").drop("edited")
    return rows.mapInArrow(_counts(ranks_of(stored.sparkSession, ranks), None, pattern), _schema(rows))

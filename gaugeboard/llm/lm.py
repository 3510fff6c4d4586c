"""Language-model scores of documents by prediction by partial matching.

The training texts' byte contexts (``ppm``) and words are counted block by block; buckets of
contexts, each holding every string whose context ends in the same two bytes, turn the counts
into code lengths and answer the blocks (``packing``).  Only the counts of byte pairs, at most
65,536 of them, are broadcast.

A NULL text is empty: its only token is the end.  A row whose id is NULL is trained on.  With
nothing to train on every byte costs log10(256) and the base formula gives 0.  Equal rows get
equal scores.  Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gaugeboard.llm import ppm
from gaugeboard.llm.packing import block_count, in_blocks, pack, split, unpack
from gaugeboard.llm.texts import column, pieces, text_column
from gaugeboard.session import materialize

ASKED = "kind int, bucket int, block int, payload binary"
GRAMS, WORDS = 0, 1
#: Stands for the end of a text among the words; no word is empty.
END_WORD = b""
TOTALS = -1


def _trained(batch: pa.RecordBatch) -> np.ndarray:
    return ~np.asarray(batch.column(batch.schema.get_field_index("held_out")).to_pylist(), dtype=bool)


def _pairs(batches):
    """Counts of (byte, next byte) in the training texts of a task."""
    counts = np.zeros(1 << 16, np.int64)
    for batch, texts in pieces(batches):
        keep = _trained(batch)
        pairs, _ = ppm.grams([t for t, k in zip(texts, keep) if k], 1)
        counts += np.bincount(pairs.astype(np.int64), minlength=1 << 16)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], ["pair", "n"])


def pair_counts(docs: DataFrame) -> np.ndarray:
    """256 x 256 counts over all training texts."""
    rows = docs.mapInArrow(_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << 16, np.int64)
    for row in rows:
        out[row["pair"]] = row["n"]
    return out.reshape(256, 256)


def _merged(held: list) -> list:
    keys, counts = ppm._sums(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
    return [(keys, counts)]


def _distinct(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    found = ppm.grams(texts, order)[0]
    found.sort()
    at = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, np.int64)
    return found[at], np.diff(np.append(at, len(found)))


def _gram_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    context = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    return ((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def _pack_words(words: list[bytes], counts) -> bytes:
    return pack(np.frombuffer(b"\n".join(words), np.uint8), np.asarray(counts, np.int64))


def _unpack_words(payload: bytes) -> tuple[list[bytes], np.ndarray]:
    raw, counts = unpack(payload)
    return raw.tobytes().split(b"\n"), counts


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())],
        ["kind", "bucket", "block", "payload"],
    )


def _words(text: bytes, lower: bool) -> list[bytes]:
    return (text.lower() if lower else text).split()  # of bytes, both know ASCII only


def _ask(order: int, buckets: int, lower: bool):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings, words, block = [], Counter(), 0
        for batch, texts in pieces(batches):
            block = batch.column(batch.schema.get_field_index("block"))[0].as_py()
            keep = _trained(batch)
            learned = [t for t, k in zip(texts, keep) if k]
            asked = [t for t, k in zip(texts, keep) if not k]
            strings.append(_distinct(learned, order))
            keys, _ = _distinct(asked, order)
            strings.append((keys, np.zeros(len(keys), np.int64)))
            if len(strings) > 8:
                strings = _merged(strings)
            for text in learned:
                words.update(_words(text, lower))
            for text in asked:
                for word in set(_words(text, lower)):
                    words.setdefault(word, 0)
            words[END_WORD] += len(learned)
        if not words:
            return
        [(keys, counts)] = _merged(strings)
        rows = [(GRAMS, b, block, pack(keys[at], counts[at].astype(np.uint32))) for b, at in split(_gram_buckets(keys, buckets), buckets)]
        named = list(words)
        number = np.fromiter(words.values(), np.int64, len(named))
        place = np.fromiter(map(zlib.crc32, named), np.int64, len(named)) % buckets
        rows += [(WORDS, b, block, _pack_words([named[i] for i in at], number[at])) for b, at in split(place, buckets)]
        for i in range(0, len(rows), 64):
            yield _answers(rows[i : i + 64])

    return ask


def _answer(order: int, pairs: np.ndarray):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(k, b, who, p) for batch in batches for k, b, who, p in zip(*(c.to_pylist() for c in batch.columns))]
        kind, bucket = asked[0][:2]
        if kind == GRAMS:
            parts = [unpack(p) for *_, p in asked]
            keys, counts = ppm._sums(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]).astype(np.int64))
            costs = ppm.code_lengths(keys, counts, pairs, order).astype(np.float32)
            for (_, _, who, _), (mine, _) in zip(asked, parts):
                yield _answers([(GRAMS, bucket, who, pack(mine, costs[np.searchsorted(keys, mine)]))])
            return
        total: dict[bytes, int] = {}
        for *_, payload in asked:
            words, counts = _unpack_words(payload)
            for word, n in zip(words, counts.tolist()):
                total[word] = total.get(word, 0) + n
        numbers = np.fromiter(total.values(), np.int64, len(total))
        yield _answers([(WORDS, bucket, TOTALS, pack(np.array([numbers.sum(), (numbers > 0).sum()], np.int64)))])
        for _, _, who, payload in asked:
            words, _ = _unpack_words(payload)
            yield _answers([(WORDS, bucket, who, _pack_words(words, [total[w] for w in words]))])

    return answer


class Lookup:
    """Values of 64-bit keys that are all present, found for whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 2.5).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        empty = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.keys, self.values = np.full(1 << bits, empty, np.uint64), np.zeros(1 << bits, values.dtype)
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = self.keys[at] == empty
            self.keys[at[free]] = keys[left[free]]
            here = self.keys[at] == keys[left]
            self.values[at[here]] = values[left[here]]
            left, at = left[~here], (at[~here] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        at = self._place(wanted)
        missed = np.flatnonzero(self.keys[at] != wanted)
        while len(missed):
            at[missed] = (at[missed] + 1) & self.mask
            missed = missed[self.keys[at[missed]] != wanted[missed]]
        return self.values[at]


def _score(order: int, lower: bool, names: list[str], id_type: pa.DataType):
    def rows(doc_id, held, tokens, known, base, score, learned, distinct):
        return pa.Table.from_arrays(
            [pa.array(doc_id, id_type) if not isinstance(doc_id, pa.Array) else doc_id, pa.array(held, pa.bool_()), *[pa.array(x, pa.int64()) for x in (tokens, known)], *[pa.array(x, pa.float64()) for x in (base, score)], *[pa.array(x, pa.int64()) for x in (learned, distinct)]],
            names=names,
        )

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kinds, payloads = (answers.column(c).to_pylist() for c in ("kind", "payload"))
        if not docs.num_rows:
            totals = sum((unpack(p)[0] for p in payloads), np.zeros(2, np.int64))
            return rows([None], [None], [None], [None], [None], [None], [totals[0]], [totals[1]])
        strings = [unpack(p) for k, p in zip(kinds, payloads) if k == GRAMS]
        cost = Lookup(np.concatenate([k for k, _ in strings]), np.concatenate([v for _, v in strings]))
        count: dict[bytes, int] = {}
        for k, p in zip(kinds, payloads):
            if k == WORDS:
                words, numbers = _unpack_words(p)
                count.update(zip(words, numbers.tolist()))
        out = []
        for batch, texts in pieces(docs.to_batches()):
            keys, begins = ppm.grams(texts, order)
            scores = np.add.reduceat(cost(keys).astype(np.float64), begins)
            tokens, known, base = [], [], []
            for text in texts:
                words = _words(text, lower)
                words.append(END_WORD)
                numbers = np.fromiter(map(count.__getitem__, words), np.int64, len(words))
                tokens.append(len(words))
                known.append(int(np.count_nonzero(numbers)))
                base.append(float(np.log10(numbers + 1.0).sum()))
            none = [None] * len(texts)
            out.append(rows(batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("held_out")), tokens, known, base, scores, none, none))
        return pa.concat_tables(out)

    return score


def held_out_by_id(doc_id: Column, modulus: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def scores(docs: DataFrame, id_col="doc_id", text_col="text", held_out: Column | None = None, order: int = ppm.ORDER, lower: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row.

    With ``lower``, words that differ only in the case of A-Z are one word.
    """
    doc_id, text = column(docs, id_col), F.coalesce(text_column(docs, text_col), F.lit(""))
    doc_id = doc_id if id_col in docs.columns else doc_id.cast("long")
    held = held_out_by_id(doc_id) if held_out is None else F.coalesce(held_out, F.lit(False))
    columns = [doc_id.alias("doc_id"), text.alias("text"), held.alias("held_out")]
    plain = docs.select(*columns)
    count = block_count(docs, text)
    blocks = in_blocks(docs, columns, [doc_id, text], count)
    pairs = pair_counts(plain.select("text", "held_out"))
    asked = blocks.groupBy("block").applyInArrow(_ask(order, count, lower), ASKED)
    answers = asked.groupBy("kind", "bucket").applyInArrow(_answer(order, pairs), ASKED)
    id_type = blocks.schema["doc_id"].dataType
    fields = [("doc_id", id_type), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()), ("learned", T.LongType()), ("distinct", T.LongType())]
    from pyspark.sql.pandas.types import to_arrow_type

    score = _score(order, lower, [n for n, _ in fields], to_arrow_type(id_type))
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    found = materialize(blocks.groupBy("block").cogroup(answers.select("block", "kind", "payload").groupBy("block")).applyInArrow(score, schema), "scores")
    total = found.agg(F.sum("learned").alias("n"), F.sum("distinct").alias("v")).first()
    learned, distinct = total["n"] or 0, total["v"] or 0
    base = F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(learned + distinct + 1)))
    return found.filter("n_tokens IS NOT NULL").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(learned).cast("long").alias("train_tokens"), base.alias("base_score"), "score"
    )

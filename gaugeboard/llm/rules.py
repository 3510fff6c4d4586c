"""Quality rules on repetition: which characters lie in duplicated n-grams and lines.

Words get integer codes per piece of text, exactly; rolling hashes of those codes give the
n-grams of every length for all texts of the piece at once.  The base rule counts the words
of n-grams found twice or more, first occurrence included; the method measures the characters of
what comes again, without it, for several lengths and for lines.  Hashes that meet are compared word
by word, so equal hashes of different n-grams do not count.

NULL and empty texts have no words and fail the base rule.  Repeated rows get equal results;
extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from gaugeboard.llm.texts import column, mixed, pieces, text_column

BASE_WINDOW = 5
LEAST_WORDS = 10
#: Largest share of characters in n-grams that the text has had before, by n.
DUPLICATE_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in lines equal to an earlier one.
LINE_SHARE = 0.20
_SYMBOLS = b"#*$%&|<>"
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_TRAILING = bytes(range(0x80, 0xC0))


def _inside(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    edges = np.zeros(total + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:-1]) > 0


def repeated(codes: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words lie in an n-gram of ``length`` words that their text has at least twice, and which in one it has had before."""
    n = len(codes) - length + 1
    none = np.zeros(len(codes), bool)
    if n <= 0:
        return none, none
    rolled = np.zeros(n, np.uint64)
    for j in range(length):
        rolled *= np.uint64(0xD1342543DE82EF95)
        rolled += codes[j : j + n].astype(np.uint64) + np.uint64(1)
    inside = doc[:n] == doc[length - 1 :]
    at = np.flatnonzero(inside)
    keys = mixed(rolled[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(keys)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return none, none
    spot = np.searchsorted(again, keys)
    spot[spot == len(again)] = 0
    hit = again[spot] == keys
    at, group = at[hit], spot[hit]
    order = np.argsort(group, kind="stable")
    at, group = at[order], group[order]
    same = np.append(False, (group[1:] == group[:-1]) & (doc[at[1:]] == doc[at[:-1]]))
    follows = np.flatnonzero(same)
    for j in range(length):
        same[follows] &= codes[at[follows] + j] == codes[at[follows - 1] + j]
    # A hash shared by different n-grams: compare all of its n-grams exactly.
    broken = np.unique(group[np.append(False, group[1:] == group[:-1]) & ~same])
    marked = same | np.append(same[1:], False)
    for g in broken:
        members = np.flatnonzero(group == g)
        seen: dict[tuple, list[int]] = {}
        for m in members.tolist():
            seen.setdefault((int(doc[at[m]]), *codes[at[m] : at[m] + length].tolist()), []).append(m)
        for found in seen.values():
            marked[found], same[found] = len(found) > 1, True
            same[found[0]] = False
    return _inside(at[marked], length, len(codes)), _inside(at[same], length, len(codes))


def _line_facts(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and their bytes in words."""
    if b"\n" not in text:
        return 0, 0
    seen, count, size = set(), 0, 0
    for line in text.split(b"\n"):
        if line in seen:
            count += 1
            size += len(line.translate(None, _SPACES + _TRAILING))
        elif line and not line.isspace():
            seen.add(line)
    return count, size


def facts(texts: list[bytes], shares: dict[int, float] = DUPLICATE_SHARES, line_share: float = LINE_SHARE) -> dict[str, np.ndarray]:
    """Counts and verdict of each text."""
    vocabulary: dict[bytes, int] = {}
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(texts))
    codes = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for one in words for w in one), np.int64, int(counts.sum()))
    sizes = np.fromiter((len(w.translate(None, _TRAILING)) for w in vocabulary), np.int64, len(vocabulary))
    doc = np.repeat(np.arange(len(texts)), counts)
    chars = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    total = np.bincount(doc, chars, len(texts)).astype(np.int64)
    base, later = repeated(codes, doc, BASE_WINDOW)
    again = np.bincount(doc[base], minlength=len(texts))
    bad = (counts < LEAST_WORDS) | (100 * again > 20 * counts)
    lines = np.array([_line_facts(t) for t in texts], np.int64).reshape(-1, 2)
    poor = lines[:, 1] > line_share * total
    for n, share in shares.items():
        inside = later if n == BASE_WINDOW else repeated(codes, doc, n)[1]
        poor |= np.bincount(doc[inside], chars[inside], len(texts)) > share * total
    symbols = np.fromiter((len(t) - len(t.translate(None, _SYMBOLS)) for t in texts), np.int64, len(texts))
    return {
        "n_words": counts, "word_chars": total, "n_symbols": symbols, "n_dup_lines": lines[:, 0], "n_repeat_words": again,
        "base_failed": bad, "kept": ~bad & ~poor,
    }


def _rate(batches):
    for batch, texts in pieces(batches):
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"}
        columns |= {n: pa.array(v) for n, v in facts(texts).items()}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def rated(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, the counts, base_failed and kept per row."""
    doc_id = column(docs, id_col)
    doc_id = doc_id if id_col in docs.columns else doc_id.cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text_column(docs, text_col).alias("text"))
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [T.StructField("doc_id", rows.schema["doc_id"].dataType), *[T.StructField(n, T.LongType()) for n in longs]]
    return rows.mapInArrow(_rate, T.StructType([*fields, T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]))

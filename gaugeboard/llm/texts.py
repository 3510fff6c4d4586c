"""Words, hashes and batches shared by the text operators.

A word is a run of bytes other than ASCII white space (0x20, 0x09 to 0x0D), which is what
``bytes.split`` takes; UTF-8 never uses those bytes inside a character.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugeboard.functions.kinds import quoted

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task works on at a time; a longer text is a piece of its own.
PIECE_BYTES = 2_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def column(df: DataFrame, name: str) -> Column:
    """A column by its literal name; a missing one reads as NULL."""
    return F.col(quoted(name)) if name in df.columns else F.lit(None)


def text_column(df: DataFrame, name: str) -> Column:
    return column(df, name).cast("string")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no working column can clash with them."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns])


def unpacked(df: DataFrame, struct: str, names: list[str]) -> list[Column]:
    return [F.col(struct).getField(n).alias(n) for n in names]


def row_beside_text(df: DataFrame, text_col: str) -> tuple[Column, Column]:
    """(row, text) so that the text is carried once: the row lacks the text column, if that is a string."""
    once = [c for c in df.columns if c != text_col or df.schema[c].dataType.typeName() != "string"]
    return F.struct(*[F.col(quoted(c)) for c in once], F.lit(0).alias("__none")), text_column(df, text_col)


def row_with_text(df: DataFrame, text_col: str, row: str = "row", text: str = "text") -> list[Column]:
    """The columns of ``df`` from what ``row_beside_text`` made."""
    whole = text_col in df.columns and df.schema[text_col].dataType.typeName() == "string"
    return [F.col(text).alias(c) if whole and c == text_col else F.col(row).getField(c).alias(c) for c in df.columns]


@functools.cache
def _trim():
    """The C library's call that hands free memory back, where there is one."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: None


def give_back() -> None:
    """Hand memory that is free back to the system; a worker lives on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def pieces(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about ``limit`` bytes of text, with the texts (NULL: empty).

    A task's memory is given back when it has seen the last of them.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()
        start = total = 0
        for at, text in enumerate(texts):
            size = len(text or b"")
            if at > start and total + size > limit:
                yield batch.slice(start, at - start), [t or b"" for t in texts[start:at]]
                start, total = at, 0
            total += size
        if start < len(texts):
            yield batch.slice(start), [t or b"" for t in texts[start:]]
        del texts
    give_back()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=2)
def _kept_powers(base: int) -> np.ndarray:
    out = np.full(PIECE_BYTES + (1 << 16), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


def _powers(base: int, n: int) -> np.ndarray:
    kept = _kept_powers(base)
    if n <= len(kept):
        return kept[:n]
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


class Words:
    """The words of several texts: where they are, whose they are, and their 64-bit hashes.

    Hashes are polynomials over the bytes, from one running sum over all texts.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edge[::2], edge[1::2]
        begins = np.cumsum(sizes + 1) - sizes
        self.first = np.searchsorted(self.starts, np.append(begins, len(raw)))
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.raw = raw

    def hashes(self) -> np.ndarray:
        n = len(self.raw)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_powers(_BASE, n) * (self.raw + np.uint64(1)), out=sums[1:])
        back = _powers(_UNBASE, n)
        return mixed((sums[self.ends] - sums[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(np.uint64))


def window_hashes(words: np.ndarray, length: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Rolling hash of every ``length`` consecutive entries, over all texts at once."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(length):
        out *= np.uint64(base)
        out += words[j : j + n]
    return mixed(out)


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """Positions at which a window of ``length`` words stays inside its text."""
    counts = np.diff(first)
    usable = np.maximum(counts - length + 1, 0)
    offset = np.repeat(first[:-1] - (np.cumsum(usable) - usable), usable)
    return np.arange(usable.sum()) + offset


def covered(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of ``total`` positions lie in a window that begins at one of ``starts``."""
    edges = np.zeros(total + 1, np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + length, total), -1)
    return np.cumsum(edges[:-1]) > 0

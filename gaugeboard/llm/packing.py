"""Blocks of documents that ask, and buckets of keys that answer.

Operators that need a fact about every distinct n-gram or window of the corpus deal the
documents into blocks by hash.  A block sends its distinct keys, packed, to buckets of the
key space; a bucket sees a key once per block, whatever its number of occurrences, and answers
each block with what the whole corpus says.  Nothing passes through the driver, no task holds
more than one block or one bucket, and a key that stands in every document costs one entry per block.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BYTES = 20_000_000


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of equal weight stand together."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
        parts += [a.dtype.str.encode().ljust(4), struct.pack("<Q", len(a)), np.ascontiguousarray(planes).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(value: bytes) -> list[np.ndarray]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(value))
    (n,), at, out = struct.unpack("<I", raw[:4]), 4, []
    for _ in range(n):
        kind, length = np.dtype(bytes(raw[at : at + 4]).decode().strip()), struct.unpack("<Q", raw[at + 4 : at + 12])[0]
        at += 12
        planes = np.frombuffer(raw[at : at + length * kind.itemsize], np.uint8).reshape(kind.itemsize, length)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(length))
        at += length * kind.itemsize
    return out


def split(buckets: np.ndarray, count: int):
    """(bucket, positions) of each bucket that occurs; positions keep their order."""
    order = np.argsort(buckets, kind="stable")
    edges = np.searchsorted(buckets[order], np.arange(count + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def text_bytes(docs: DataFrame, text: Column) -> int:
    return docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def block_count(docs: DataFrame, text: Column, total: int | None = None) -> int:
    """Blocks of a bounded size; at least as many as shuffle partitions, so that a block's own partitioning is kept."""
    total = text_bytes(docs, text) if total is None else total
    return max(1, -(-total // BLOCK_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def in_blocks(docs: DataFrame, columns: list[Column], key: list[Column], count: int) -> DataFrame:
    """The columns with ``block``, each block in one partition."""
    block = F.pmod(F.xxhash64(*key), F.lit(count)).cast("int")
    return docs.select(block.alias("block"), *columns).repartition(count, "block")

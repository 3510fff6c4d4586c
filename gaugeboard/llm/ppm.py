"""Prediction by partial matching over bytes: code lengths from a trie of contexts.

The trie's nodes are byte strings of up to ORDER + 1 bytes with their counts in the training
texts.  A string of k + 1 bytes is a context of k bytes and the symbol that followed.  Every
position counts at every order, so the symbols seen after a context were also seen after its
suffixes: the symbols excluded at order k are those seen at order k + 1.

With n the count of the symbol, T the sum of counts and D the number of symbols of a context,
both without the excluded, a symbol has n / (T + D) and the escape D / (T + D) (method C).
Below order 0 every symbol not yet seen is equally likely.  END stands before and after
each text; UTF-8 has no such byte.
"""

from __future__ import annotations

import numpy as np

ORDER = 5
END = 0xFF


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-byte strings that end at each symbol, and where each text's begin."""
    gap = bytes([END]) * order
    raw = np.frombuffer(gap + gap.join(texts) + gap if texts else b"", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n = len(raw) - order
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    value = np.zeros(n, np.uint64)
    for j in range(order + 1):
        value <<= np.uint64(8)
        value |= raw[j : j + n]
    begins = np.cumsum(sizes + order) - sizes - order  # symbol i of a text is the gram at its begin + i
    last = begins + sizes
    keep = np.zeros(n + 1, np.int8)
    np.add.at(keep, begins, 1)
    np.add.at(keep, last + 1, -1)
    return value[np.cumsum(keep[:-1], dtype=np.int8) > 0], np.cumsum(sizes + 1) - sizes - 1


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(counts, at)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in sorted keys (0 where absent) and whether present."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def code_lengths(wanted: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 probability of the last byte of each wanted string after its other bytes.

    ``counts``: occurrences in training.  All trained strings that share a context of two bytes with
    a wanted one must be among them.  ``pairs``: 256 x 256 counts of (byte, next) in all of training.
    """
    out, open_ = np.zeros(len(wanted)), np.ones(len(wanted), bool)
    excluded_sum, excluded = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    trained = counts > 0
    keys, sums = wanted[trained], counts[trained]
    for k in range(order, -1, -1):
        if k >= 2:
            if k < order:
                keys, sums = _sums(keys & np.uint64((1 << 8 * (k + 1)) - 1), sums)
            level, number = keys, sums
        else:
            dense = pairs if k == 1 else pairs.sum(axis=0, keepdims=True)
            level = np.flatnonzero(dense).astype(np.uint64)
            number = dense.ravel()[level.astype(np.int64)]
        node = wanted & np.uint64((1 << 8 * (k + 1)) - 1)
        contexts, at = np.unique(level >> np.uint64(8), return_index=True)
        total = np.add.reduceat(number, at) if len(at) else number
        distinct = np.diff(np.append(at, len(level)))
        where, seen = _find(contexts, node >> np.uint64(8))
        if not len(contexts):
            continue
        spot, has = _find(level, node)
        t, d = total[where] - excluded_sum, distinct[where] - excluded
        scale = np.maximum(t + d, 1)
        found = open_ & seen & has
        out[found] += np.log10(number[spot[found]] / scale[found])
        escaped = open_ & seen & ~has & (d > 0)
        out[escaped] += np.log10(d[escaped] / scale[escaped])
        open_ &= ~found
        if k:
            # What the symbols of this context count for one order lower.
            lower = level & np.uint64((1 << 8 * k) - 1)
            if k > 2:
                below_keys, below_sums = _sums(lower, number)
                below = below_sums[np.searchsorted(below_keys, lower)]
            else:
                dense = pairs if k == 2 else pairs.sum(axis=0, keepdims=True)
                below = dense.ravel()[lower.astype(np.int64)]
            excluded_sum = np.where(seen, np.add.reduceat(below, at)[where], 0)
            excluded = np.where(seen, distinct[where], 0)
    out[open_] -= np.log10(max(256 - np.count_nonzero(pairs.sum(axis=0)), 1))
    return out

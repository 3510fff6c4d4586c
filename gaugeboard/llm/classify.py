"""Quality classifier: supervised subword embeddings.

A word has hashed features: itself and the byte n-grams of the word with its borders.  Two
neighbouring words are a feature too, by whether they are equal.  A text is the mean of its
features' learned vectors; a softmax over the classes follows.  Vectors and output weights are
learned by stochastic gradient descent in numpy, in one task, on a bounded sample of labelled
rows.  As everything after the vectors is linear, a trained model is one number per hash bucket:
what is broadcast has a fixed size, and scoring sums numbers per distinct word.

NULL is an empty text, which scores by the bias alone.  Labels other than 0 and 1, and labels
without a document, are not learned from.  Equal texts score equally.  Without labels of both
classes the score is the share of label 1, or 0.5 without any.  Extra columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gaugeboard.llm.packing import pack, unpack
from gaugeboard.llm.texts import Words, column, give_back, pieces, row_beside_text, row_with_text, text_column, window_hashes, window_starts

BUCKETS = 1 << 18
#: About so many labelled rows, chosen by the hash of their id, are learned from; never more than twice as many.
SAMPLE = 4_000
#: Text that the training task takes at most, in whole texts.
TRAIN_BYTES = 64_000_000
DIMENSIONS = 8
EPOCHS = 6
#: Small samples are gone through more often, up to so many steps.
LEAST_STEPS = 400
BATCH = 32
RATE = 2.0
THRESHOLD = 0.7
NGRAMS = (2, 3, 4)
SAME, DIFFERENT = 0, 1
#: A pair of neighbours weighs as much as so many n-grams.
PAIR_WEIGHT = 10


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every feature of the words; the first two buckets are left to pairs of words."""
    raw = np.frombuffer(b"".join([b"<%b>" % w for w in words]), np.uint8).astype(np.uint64)
    first = np.append(0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2))
    owner = np.repeat(np.arange(len(words)), np.diff(first))
    found, hashes = [np.arange(len(words))], [Words([b" ".join(words)]).hashes()]
    for n in NGRAMS:
        at = window_starts(first, n)
        found.append(owner[at])
        hashes.append(window_hashes(raw + np.uint64(n << 8), n)[at])
    buckets = np.concatenate(hashes) % np.uint64(BUCKETS - 2) + np.uint64(2)
    return np.concatenate(found), buckets.astype(np.int64)


def _ragged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for one in lists for x in one), np.int64, int(sizes.sum())), np.append(0, np.cumsum(sizes))


def _slices(flat: np.ndarray, bounds: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ragged rows ``chosen``, one after another, and their sizes."""
    sizes = bounds[chosen + 1] - bounds[chosen]
    at = np.arange(sizes.sum()) + np.repeat(bounds[chosen] - (np.cumsum(sizes) - sizes), sizes)
    return flat[at], sizes


def train(texts: list[bytes], labels: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """One number per bucket, and the bias, of the log-odds of label 1."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return np.zeros(BUCKETS, np.float32), float(np.clip(np.log(max(share, 1e-6) / max(1 - share, 1e-6)), -14, 14))
    vocabulary: dict[bytes, int] = {}
    rows, weights, pairs = [], [], []
    for text in texts:
        words = text.split()
        counts = Counter(words)
        rows.append([vocabulary.setdefault(w, len(vocabulary)) for w in counts])
        weights.append(list(counts.values()))
        same = sum(map(eq, words, words[1:]))
        pairs.append((same, max(0, len(words) - 1 - same)))
    owner, flat = features(list(vocabulary))
    flat, bounds = flat[np.argsort(owner, kind="stable")], np.append(0, np.cumsum(np.bincount(owner, minlength=len(vocabulary))))
    in_doc, doc_bounds = _ragged(rows)
    times = np.fromiter((n for one in weights for n in one), np.float64, len(in_doc))
    pairs = PAIR_WEIGHT * np.array(pairs, np.float64)
    of_word = np.diff(bounds).astype(np.float64)
    per_word = times * of_word[in_doc] if len(in_doc) else times
    totals = np.array([per_word[a:z].sum() for a, z in zip(doc_bounds, doc_bounds[1:])]) + pairs.sum(axis=1)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    output, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    squares = np.full(BUCKETS, 1e-8)
    per_epoch = -(-len(texts) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // per_epoch))
    done, steps = 0, epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            docs = order[i : i + BATCH]
            words, sizes = _slices(in_doc, doc_bounds, docs)
            counts, _ = _slices(times, doc_bounds, docs)
            owner = np.repeat(np.arange(len(docs)), sizes)
            scale = counts / np.maximum(totals[docs], 1)[owner]
            used, inverse = np.unique(words, return_inverse=True)
            buckets, n = _slices(flat, bounds, used)
            starts = np.cumsum(n) - n
            word_vectors = np.add.reduceat(vectors[buckets], starts) if len(used) else np.zeros((0, DIMENSIONS))
            pair_share = pairs[docs] / np.maximum(totals[docs], 1)[:, None]
            means = pair_share @ vectors[:2]
            for d in range(DIMENSIONS):
                means[:, d] += np.bincount(owner, word_vectors[inverse, d] * scale, len(docs))
            scores = means @ output.T + bias
            chance = np.exp(scores - scores.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(docs)), labels[docs]] -= 1
            back = chance @ output
            output -= rate / len(docs) * chance.T @ means
            bias -= rate / len(docs) * chance.sum(axis=0)
            grads = np.stack([np.bincount(inverse, back[owner, d] * scale, len(used)) for d in range(DIMENSIONS)], axis=1)
            touched, where = np.unique(buckets, return_inverse=True)
            spread = np.repeat(np.arange(len(used)), n)
            moved = np.stack([np.bincount(where, grads[spread, d], len(touched)) for d in range(DIMENSIONS)], axis=1)
            touched, moved = np.append([SAME, DIFFERENT], touched), np.concatenate([pair_share.T @ back, moved])
            # Each bucket's step is scaled by the gradients it has had, so that rare ones learn too.
            squares[touched] += (moved**2).mean(axis=1)
            vectors[touched] -= rate * 0.1 * moved / np.sqrt(squares[touched])[:, None]
    return (vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0])


def score_texts(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """Chance of label 1 of each text; every different word's features are summed once."""
    words = Words(texts)
    hashes, doc = words.hashes(), words.doc
    different, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    raw = words.raw.tobytes()
    owner, buckets = features([raw[a:z] for a, z in zip(words.starts[first].tolist(), words.ends[first].tolist())])
    sums, sizes = np.bincount(owner, weights[buckets], len(different)).astype(float), np.bincount(owner, minlength=len(different))
    total = np.bincount(doc, sums[which], len(texts)).astype(float)
    n = np.bincount(doc, sizes[which], len(texts))
    neighbours = doc[1:] == doc[:-1]
    same = np.bincount(doc[1:][neighbours & (hashes[1:] == hashes[:-1])], minlength=len(texts)) * PAIR_WEIGHT
    pairs = np.bincount(doc[1:][neighbours], minlength=len(texts)) * PAIR_WEIGHT
    total += same * float(weights[SAME]) + (pairs - same) * float(weights[DIFFERENT])
    return 1 / (1 + np.exp(-(bias + total / np.maximum(n + pairs, 1))))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model, from rows in the order of their hashes, as far as TRAIN_BYTES of whole texts go."""
    rows, size = [], 0
    for batch, texts in pieces(batches):
        for text, label in zip(texts, batch.column(batch.schema.get_field_index("label")).to_pylist()):
            size += len(text)
            if size <= TRAIN_BYTES:
                rows.append((text, label))
    rows.sort()
    weights, bias = train([t for t, _ in rows], np.array([y for _, y in rows], np.int64))
    rows.clear()
    give_back()
    yield pa.RecordBatch.from_arrays([pa.array([pack(weights, np.array([bias]))], pa.binary())], ["model"])


def held_out_by_id(doc_id: Column, modulus: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Train on a sample of the labelled rows that are not held out."""
    usable = labels.select(column(labels, id_col).cast("string").alias("id"), column(labels, label_col).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out_by_id(F.col("id"))
    )
    share = min(1.0, sample / max(usable.count(), 1))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    # Least hashes first, so that a rerun takes the same rows where there are too many.
    chosen = usable.filter(place < share).orderBy(place, "id", "label").limit(2 * sample)
    texts = docs.select(column(docs, id_col).cast("string").alias("id"), text_column(docs, text_col).alias("text"))
    order = [F.xxhash64("id"), F.xxhash64("text"), "label"]
    rows = texts.join(F.broadcast(chosen), "id").orderBy(*order).limit(2 * sample)
    model = rows.repartition(1).sortWithinPartitions(*order).select("text", "label").mapInArrow(_train, "model binary").collect()
    if not model:
        return train([], np.zeros(0, np.int64))
    weights, bias = unpack(bytes(model[0]["model"]))
    return weights, float(bias[0])


def _score(model, without: tuple[str, ...]):
    def score(batches):
        weights, bias = model.value
        for piece, texts in pieces(batches):
            kept = {n: piece.column(i) for i, n in enumerate(piece.schema.names) if n not in without}
            kept["score"] = pa.array(score_texts(texts, weights, bias))
            yield pa.RecordBatch.from_arrays(list(kept.values()), list(kept))

    return score


def scored(rows: DataFrame, model: tuple[np.ndarray, float], without: tuple[str, ...] = ("text",)) -> DataFrame:
    """``rows`` with ``score`` for their ``text``, and ``without`` some columns."""
    kept = [T.StructField(f.name, f.dataType) for f in rows.schema if f.name not in without]
    return rows.mapInArrow(_score(rows.sparkSession.sparkContext.broadcast(model), without), T.StructType([*kept, T.StructField("score", T.DoubleType())]))


def scores(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted per row."""
    doc_id = column(docs, id_col)
    doc_id = doc_id if id_col in docs.columns else doc_id.cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out_by_id(doc_id).alias("held_out"), text_column(docs, text_col).alias("text"))
    found = scored(rows, fitted(docs, labels, id_col, text_col, label_col))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least the threshold, unchanged."""
    model = fitted(docs, labels, id_col, text_col, label_col)
    row, text = row_beside_text(docs, text_col)
    found = scored(docs.select(row.alias("row"), text.alias("text")), model, without=())
    return found.filter(F.col("score") >= threshold).select(*row_with_text(docs, text_col))

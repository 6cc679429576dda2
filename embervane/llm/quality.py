"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

A document's features are its white-space words and the n-grams of 3 to 5 characters inside ``_word_`` (one blank on
either side), hashed into ``2**BUCKET_BITS`` learned vectors. A document is the mean vector of all its features; a
linear softmax layer gives the class. Vectors and layer are trained by plain numpy stochastic gradient descent on
labelled documents, a part of which is held out to set the threshold.

Training uses at most ``MAX_TRAIN`` labelled documents, whole, chosen by a hash of ``doc_id`` (the documented bound; of several
texts of one doc_id the lowest counts); the classifier runs on every document. At inference the softmax of a mean of vectors is linear in the features, so each
bucket's contribution is one float: a table of 1 MB that each executor gets once, whatever the corpus is.

Scale: scoring is one narrow stage without shuffle, numpy over Arrow buffers; training's cost doesn't grow with the corpus.

Defined results: null, empty and blank texts have no features, score 0 and are rejected; a document is rejected if its
probability of good quality is below the threshold, and kept at the threshold itself; texts of any length are read whole; repeated
rows score alike; labels of unknown documents, null labels and
null ids are ignored; with fewer than two classes among the labels nothing is rejected but empty texts (score 1);
further columns pass unchanged in ``filter_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SpanHash, buffers, lean, mix, small_batches, spaces, steps, words

BUCKET_BITS = 18
DIM = 8
NGRAMS = (3, 4, 5)
MAX_TRAIN = 3000
HOLD_OUT = 4  # every 4th labelled document sets the threshold
EPOCHS = 6
MIN_STEPS = 200  # few documents are gone through more often
RATE = 2.0
BATCH = 32
#: Of the held-out good documents, at most this share may fall under the threshold.
GOOD_LOST = 0.005


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, first feature of each row) for words and then for each n-gram length; rows are contiguous in ``data``."""
    shift = np.uint64(64 - BUCKET_BITS)
    blank = spaces(data)
    hashes = SpanHash(data)
    start, end, first = words(data, offsets, blank)
    yield (hashes.of(start, end) >> shift).astype(np.int32), first
    # one blank before and after each row, so n-grams see where its first and last word end
    rows = len(offsets) - 1
    at = np.arange(len(data)) + 1 + np.repeat(np.arange(rows), np.diff(offsets))
    wide = np.full(len(data) + rows + 1, 32, np.uint8)
    wide[at] = np.where(blank, 32, data)
    inside = wide != 32
    depth = np.zeros(len(wide) + 1, np.int32)
    np.cumsum(~inside, out=depth[1:])
    hashes = SpanHash(wide)
    bounds = offsets + np.arange(rows + 1)
    ascii_only = not (wide > 127).any()
    lead = None if ascii_only else np.append(np.flatnonzero((wide & 0xC0) != 0x80), len(wide))
    for n in NGRAMS:
        if ascii_only:
            h = hashes.sliding(n)
            # no blank strictly inside, and not both ends blank around nothing
            at = np.flatnonzero(depth[n - 1 : len(wide)][: len(h)] == depth[1 : len(h) + 1])
            h = h[at]
        else:  # characters of several bytes: spans from one leading byte to the n-th after it
            begin, end = lead[: max(0, len(lead) - n)], lead[n:]
            ok = depth[lead[n - 1 : -1]] == depth[begin + 1] if len(begin) else np.zeros(0, bool)
            at = begin[ok]
            h = (hashes.sums[end[ok]] - hashes.sums[at]) * hashes.down[at]
        h = mix(h + np.uint64(n))
        yield (h >> shift).astype(np.int32), np.searchsorted(at, bounds)


@dataclass
class Model:
    """``weight``: the score of each bucket (difference of the two logits), ``bias``, and the ``threshold`` on P(good)."""

    weight: np.ndarray
    bias: float
    threshold: float

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(good) of each row; 0 for rows without features."""
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for bucket, first in features(data, offsets):
            sums = np.concatenate([[0.0], np.cumsum(self.weight[bucket], dtype=np.float64)])
            total += sums[first[1:]] - sums[first[:-1]]
            count += np.diff(first)
        p = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -40, 40)))
        return np.where(count > 0, p, 0.0)


def _sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, their share of all features) of each text."""
    out = []
    for a, b in steps(np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])):
        data, offsets = buffers(pa.array(texts[a:b], pa.string()))
        parts = list(features(data, offsets))
        for i in range(b - a):
            bucket, n = np.unique(np.concatenate([h[f[i] : f[i + 1]] for h, f in parts]), return_counts=True)
            out.append((bucket, (n / max(1, n.sum())).astype(np.float32)))
    return out


def fit(texts: list[str], good: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Train on texts and 0/1 labels; every ``HOLD_OUT``-th is held out for the threshold."""
    good = np.asarray(good, np.int64)
    held = np.arange(len(texts)) % HOLD_OUT == HOLD_OUT - 1
    if len(set(good[~held].tolist())) < 2:
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), 40.0, 0.5)
    rows = _sparse(texts)
    train = [i for i in np.flatnonzero(~held) if len(rows[i][0])]
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    # each class weighs the same in all, so a rare one is learned
    weight = (len(good) / (2 * np.bincount(good, minlength=2).clip(1))).astype(np.float32)
    order = rng.permutation(train)
    batches = []
    for k in range(0, len(order), BATCH):
        own = order[k : k + BATCH]
        bucket = np.concatenate([rows[i][0] for i in own])
        share = np.concatenate([rows[i][1] for i in own])
        n = np.array([len(rows[i][0]) for i in own])
        by = np.argsort(bucket, kind="stable")
        distinct, begin = np.unique(bucket[by], return_index=True)
        batches.append((own, bucket, share, np.cumsum(n) - n, np.repeat(np.arange(len(own), dtype=np.int32), n)[by], share[by], distinct, begin))
    epochs = max(epochs, -(-MIN_STEPS // max(1, len(batches))))
    del rows
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for own, bucket, share, first, doc, by_share, distinct, begin in batches:
            hidden = np.add.reduceat(vectors[bucket] * share[:, None], first)
            z = hidden @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), good[own]] -= 1
            p *= weight[good[own]][:, None] / len(own)
            back = p @ layer.T
            layer -= step * hidden.T @ p
            bias -= step * p.sum(0)
            vectors[distinct] -= step * len(own) * np.add.reduceat(back[doc] * by_share[:, None], begin)
    score = vectors @ (layer[:, 1] - layer[:, 0])
    model = Model(score.astype(np.float32), float(bias[1] - bias[0]), 0.5)
    kept = [t for i, t in enumerate(texts) if held[i]]
    p = model.probability(*buffers(pa.array(kept, pa.string())))
    known = np.sort(p[(good[held] == 1) & (p > 0)])
    if len(known):
        model.threshold = min(0.5, float(known[int(GOOD_LOST * len(known))]))
    return model


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on the labelled documents whose hashed ids are lowest, at most ``max_train`` of them."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "good").agg(F.min("text").alias("text")).toArrow().to_pydict()
    by = sorted(range(len(rows["doc_id"])), key=lambda i: (rows["doc_id"][i], rows["text"][i]))
    return fit([rows["text"][i] for i in by], np.array([int(rows["good"][i] > 0) for i in by], np.int64))


def scorer(docs: DataFrame, model: Model):
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    @lean
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            data, offsets = buffers(texts)
            parts = [own.probability(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in steps(offsets)]
            yield pa.array(np.concatenate([np.zeros(0), *parts]))

    return probability


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, quality_score, keep) of every document."""
    model = train(docs, labels, max_train)
    scored = docs.select("doc_id", scorer(docs, model)(F.col("text")).alias("quality_score"))
    return scored.select("doc_id", "quality_score", (F.col("quality_score") >= F.lit(model.threshold)).alias("keep"))


def filter_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    model = train(docs, labels, max_train)
    return docs.where(scorer(docs, model)(F.col("text")) >= F.lit(model.threshold))

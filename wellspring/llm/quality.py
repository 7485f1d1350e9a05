"""Quality scores: hashed word n-grams and logistic regression by follow-the-regularised-leader.

Tokens are runs of letters and digits and runs of punctuation. A text's features are
its tokens, pairs of adjacent tokens (one shared feature if both are equal), whether a
token repeats the last but one, and the letter case of tokens, hashed into ``2**BITS`` buckets; values are shares of the
text's tokens, so a text of any length has the same weight.

Training takes a bounded sample (``SAMPLE`` labelled documents, chosen by hash) in
``SHARDS`` tasks that each make FTRL-proximal updates in a fixed order; the model is
the mean of their weights. Its size is fixed by the hash, so it is broadcast. A score
is a sparse dot product: the sum of the weights of a text's features.

Edges: null and empty texts have no features and get the score of the bias; labels
that are null or have no document are not used; a document with several labels is used
once per label; without labels every score is 0.5; equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.words import ROLL, mix, separators, slices, spaces, text_bytes, words_of

BITS = 18
SAMPLE = 20_000
SHARDS = 4
EPOCHS = 4
GAIN = 16.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
PREDICTED = 0.7


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _kinds() -> np.ndarray:
    out = np.where(separators(), 2, 1).astype(np.uint8)
    out[spaces()] = 0
    return out


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, text after text, and where each text begins; four per token."""
    w = words_of(data, offsets, _kinds())
    n = len(w.hashes)
    if not n:
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    pair = np.zeros(n, np.uint64)
    pair[1:] = mix(w.hashes[:-1] * np.uint64(ROLL) + w.hashes[1:])
    pair[1:][w.hashes[1:] == w.hashes[:-1]] = 1
    pair[w.first[:-1][np.diff(w.first) > 0]] = 2
    upper = (data >= 0x41) & (data <= 0x5A)
    count = np.add.reduceat(upper, w.starts)
    size = w.ends - w.starts
    shape = np.uint64(3) + np.minimum(count, 2).astype(np.uint64) * np.uint64(2) + ((count == size) & (size > 1))
    again = np.full(n, 11, np.uint64)
    again[2:] += (w.hashes[2:] == w.hashes[:-2]) & (w.doc()[2:] == w.doc()[:-2])
    found = np.stack([w.hashes, mix(pair ^ np.uint64(0x5BF03635D1A4E37B)), mix(shape), mix(again)], axis=1)
    return (found >> np.uint64(64 - BITS)).astype(np.int64).ravel(), w.first * 4


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, labels = [], []
    for batch in batches:
        data, offsets = text_bytes(batch["text"])
        for a, b in slices(offsets):
            bucket, first = _features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for i in range(b - a):
                x, n = np.unique(bucket[first[i] : first[i + 1]], return_counts=True)
                rows.append((x.astype(np.int32), (n * (GAIN / max(1, n.sum()))).astype(np.float32)))
        labels += batch["label"].to_pylist()
    if not rows:
        return
    weights, bias = ftrl(rows, labels, 1 << BITS)
    used = np.flatnonzero(weights)
    yield pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array([used.astype("<i4").tobytes()], pa.binary()),
            "weight": pa.array([weights[used].astype("<f4").tobytes()], pa.binary()),
            "bias": [bias],
        }
    )


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], size: int) -> tuple[np.ndarray, float]:
    """Weights after ``EPOCHS`` passes of FTRL-proximal; the bias is the last weight, without penalty."""
    z, g2 = np.zeros(size + 1), np.zeros(size + 1)

    def weight(at: np.ndarray) -> np.ndarray:
        penalty = np.where(at == size, 0.0, L1)
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - penalty, 0)
        return -shrunk / ((BETA + np.sqrt(g2[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for (x, value), label in zip(rows, labels, strict=True):
            at, value = np.append(x, size), np.append(value, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            z[at] += g - (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / ALPHA * w
            g2[at] += g * g
    w = weight(np.arange(size + 1))
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most about ``sample`` rows of ``labels`` (doc_id, ``label``)."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull()).select(
        F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")
    )
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.where((F.abs(F.xxhash64("doc_id") % 1_000_003) + 0.5) / 1_000_003 <= share)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    dealt = rows.repartition(SHARDS, F.xxhash64("doc_id")).sortWithinPartitions(F.xxhash64("doc_id", F.lit(7)), "text", "label")
    parts = dealt.select("text", "label").mapInArrow(_fit, "bucket binary, weight binary, bias double").collect()
    weights = np.zeros(1 << BITS)
    for part in parts:
        weights[np.frombuffer(part["bucket"], "<i4")] += np.frombuffer(part["weight"], "<f4") / len(parts)
    return Model(weights.astype(np.float32), sum(p["bias"] for p in parts) / max(1, len(parts)))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            parts = []
            for a, b in slices(offsets):
                bucket, first = _features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total = np.concatenate([[0.0], np.cumsum(model.weights[bucket], dtype=float)])[first]
                parts.append(np.diff(total) * (GAIN / np.maximum(1, np.diff(first))))
            dot = np.concatenate(parts) if parts else np.empty(0)
            score = 1 / (1 + np.exp(-np.clip(dot + model.bias, -35, 35)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": score})

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (the probability of label 1) and predicted, one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(shared), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= PREDICTED).cast("int"))

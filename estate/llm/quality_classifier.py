"""A quality classifier of supervised subword embeddings.

Every word, every pair of neighbouring words and every character n-gram of a word and
its bounds is hashed to a learned vector. A document is the mean of its vectors; a softmax over two outputs follows. The
vectors and the outputs are trained by stochastic gradient descent in numpy, on a
bounded sample of labelled rows that is drawn by hash. For scoring, the mean and the
output layer are linear, so the vector of each bucket is multiplied into the outputs
once; a document is then the mean of one number per feature, over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estate.llm.common import ship

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
DIMENSIONS = 16
# Single steps of the descent at least; small samples are gone through more often.
STEPS = 12_000
RATE = 0.5
# At most so many labelled rows train the model, and no more rows once they hold so
# many different features in all: what the driver holds does not grow with the corpus.
SAMPLE_ROWS = 4_000
SAMPLE_FEATURES = 8_000_000
# Texts are hashed together up to about so many bytes.
CHUNK_BYTES = 4_000_000
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_PRIME = np.uint32(0x9E3779B1)
_OFFSET = np.uint32(0x85EBCA6B)


class Model(NamedTuple):
    """Difference of the two outputs for each bucket, and the bias."""

    weights: np.ndarray
    bias: float


def _features(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and byte position of every feature in texts that start at ``texts``.

    Each text ends with a space. Features are runs of n bytes with no space strictly
    inside, whole words, and pairs of neighbouring words; a pair of equal words is one
    feature whatever the word. Each kind is found for all texts at once.
    """
    shift = np.uint32(33 - BUCKETS.bit_length())
    space = _SPACES[data]
    wide = np.where(space, np.uint32(32), data.astype(np.uint32))
    buckets, places = [], []

    def add(name: np.ndarray, at: np.ndarray, kind: int) -> None:
        mixed = (name * _PRIME) ^ np.uint32(kind)
        buckets.append(((mixed * _PRIME) >> shift).astype(np.int32))
        places.append(at)

    rolled = np.full(len(data), _OFFSET, np.uint32)
    broken = np.zeros(len(data), bool)
    for n in range(1, min(max(SIZES), len(data)) + 1):
        left = len(data) - n + 1
        rolled = (rolled[:left] * _PRIME) ^ wide[n - 1 :]
        broken = broken[:left] | space[n - 2 : n - 2 + left] if n > 2 else broken[:left]
        if n in SIZES:
            at = np.flatnonzero(~broken & ~(space[:left] & space[n - 1 :]))
            add(rolled[at], at, n)
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    if len(starts):
        # The sum of mixed bytes, each with its place in the word, names the word.
        place = np.arange(len(data), dtype=np.uint32)
        place[starts[0] :] -= np.repeat(starts.astype(np.uint32), np.diff(np.append(starts, len(data))))
        mixed = (wide + _OFFSET) * (place * np.uint32(2) + np.uint32(1)) * _PRIME
        mixed ^= mixed >> np.uint32(15)
        mixed[space] = 0
        word = np.add.reduceat(mixed, starts, dtype=np.uint32)
        add(word, starts, 0)
        after = np.ones(len(starts), bool)
        first = np.searchsorted(starts, texts)
        after[first[first < len(starts)]] = False
        second = np.flatnonzero(after)
        pair = np.where(word[second] == word[second - 1], _OFFSET, word[second] * _OFFSET ^ word[second - 1])
        add(pair, starts[second], 1)
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(places)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, joined bytes (a space after each text) and the start of each text."""
    held, size, first = [], 0, 0
    for row, value in enumerate(texts):
        held.append((value.as_py() or "").encode("utf-8"))
        size += len(held[-1])
        if size >= CHUNK_BYTES or row == len(texts) - 1:
            data = np.frombuffer(b" ".join(held) + b" ", np.uint8)
            starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in held])[:-1]))
            yield first, data, starts
            held, size, first = [], 0, row + 1


def sample_features(sample: DataFrame) -> DataFrame:
    """``label``, ``order`` and the counted features of each row of a labelled sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for text in batch["text"]:
                data = np.frombuffer((text.as_py() or "").encode("utf-8") + b" ", np.uint8)
                bucket, count = np.unique(_features(data, np.zeros(1, int))[0], return_counts=True)
                found.append(bucket)
                counts.append(count.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch["order"], batch["label"], pa.array(found, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                ["order", "label", "features", "counts"],
            )

    return sample.select("order", "label", "text").mapInArrow(
        run, "order bigint, label int, features array<int>, counts array<int>"
    )


def descend(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """Train vectors and outputs on (label, features, counts) by stochastic gradient descent."""
    random = np.random.default_rng(seed)
    vectors = ((random.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    outputs, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    rows = [r for r in rows if len(r[1])]
    # Features vary in how often they occur; the weights of a document sum to one.
    shares = [(c / c.sum()).astype(np.float32) for _, _, c in rows]
    epochs = -(-STEPS // len(rows)) if rows else 0
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for n in random.permutation(len(rows)):
            label, features, share = rows[n][0], rows[n][1], shares[n]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = share @ vectors[features]
            score = outputs @ mean + bias
            wrong = np.exp(score - score.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            back = wrong @ outputs
            outputs -= rate * np.outer(wrong, mean)
            bias -= rate * 0.1 * wrong
            # The step of a vector follows its share; scaled up as the shares are small.
            vectors[features] -= (rate * 20) * np.outer(share, back)
    return Model((vectors @ (outputs[1] - outputs[0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    rows: int = SAMPLE_ROWS, features: int = SAMPLE_FEATURES,
) -> Model:
    """A model from at most ``rows`` labelled documents, those of the smallest hash.

    Labels other than 0 and 1 and null keys are passed over. A label given twice counts
    once; of two different ones the larger. Without any labelled text every score is a
    half.
    """
    ship(docs.sparkSession)
    chosen = (
        labels.where(F.col(label).isin(0, 1)).where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("label"))
        .withColumn("order", F.xxhash64("_key")).orderBy("order", "_key").limit(rows)
    )
    sample = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(chosen), "_key")
    found, held = [], 0
    for row in sample_features(sample).orderBy("order").limit(rows).toLocalIterator():
        held += len(row.features)
        if held > features:
            break
        found.append((row.label, np.array(row.features, np.int32), np.array(row.counts, np.float64)))
    return descend(found)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score``, the chance of label 1, of every whole text.

    Null and empty texts have no features and get the score of the bias alone. Repeated
    rows are scored each. Other columns are not read. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            logits = np.zeros(len(batch))
            for first, data, starts in _chunks(batch["text"]):
                bucket, place = _features(data, starts)
                if len(bucket):
                    row = np.searchsorted(starts, place, "right") - 1
                    n = np.bincount(row, minlength=len(starts))
                    total = np.bincount(row, weights[bucket], minlength=len(starts))
                    logits[first : first + len(starts)] = total / np.maximum(n, 1)
            chance = 1 / (1 + np.exp(-np.clip(logits + bias, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(chance)], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 5 == 0

"""Quality classifier (operator 7): supervised subword embeddings.

The words of a text, pairs of words and the 3- and 4-grams of their characters (with one white space at either end as a word border) hash to
buckets. Every bucket has a vector; a document is the average of its features' vectors, and a softmax over the average gives
the class. Vectors and softmax are learned together by stochastic gradient descent in numpy, on a bounded sample of labelled
documents (whole texts), whose hashed features are counted by the executors.

For scoring, the difference of the two class weights is multiplied into the vectors once: the logit of an average is
the average of one number per feature, so scoring is a table look-up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import words as W

BITS = 17
DIMENSIONS = 8
#: Bound of the training sample: labelled documents with the smallest hashes of their ids.
SAMPLE = 4_000
EPOCHS = 6
RATE = 0.5
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, text by text, and where each text's begin (with the end of the last)."""
    joined = "\n" + "\n".join((t or "") for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
    begins = 1 + np.cumsum(lengths + 1) - (lengths + 1)
    white = (points == 32) | ((points >= 9) & (points <= 13))
    wide = points.astype(np.uint64) + np.uint64(1)
    wide[white] = 1
    place, bucket = [], []
    for n in (3, 4):
        count = len(points) - n + 1
        if count <= 0:
            continue
        inner = ~white[1 : 1 + count]
        for j in range(2, n - 1):
            inner = inner & ~white[j : j + count]
        at = np.flatnonzero(inner)
        value = np.zeros(len(at), np.uint64)
        for j in range(n):
            value += wide[at + j] * _MULTIPLIERS[j]
        place.append(at + 1)
        bucket.append(W.mix(value ^ np.uint64(n)))
    starts = np.flatnonzero(~white[1:] & white[:-1]) + 1
    if len(starts):
        ends = np.flatnonzero(white[1:] & ~white[:-1]) + 1
        size = ends - starts
        at = W.within(size)
        marks = wide[at + np.repeat(starts, size)] * W.powers(W._BASE, int(size.max()))[at]
        word = W.mix(np.add.reduceat(marks, np.cumsum(size) - size))
        place.append(starts)
        bucket.append(word)
        # word pairs within a text; all pairs of a word with itself are one feature
        pair = np.flatnonzero(np.searchsorted(begins, starts[1:], "right") == np.searchsorted(begins, starts[:-1], "right"))
        place.append(starts[1:][pair])
        bucket.append(W.mix(np.where(word[1:] == word[:-1], np.uint64(1), word[1:] * _MULTIPLIERS[1] + word[:-1]))[pair])
    if not place:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    place, bucket = np.concatenate(place), np.concatenate(bucket) >> np.uint64(64 - BITS)
    order = np.argsort(place, kind="stable")
    return bucket[order].astype(np.int64), np.searchsorted(place[order], np.append(begins, len(points)))


@dataclass(frozen=True)
class Model:
    """``table`` is the contribution of each bucket to the logit of class 1; ``bias`` is the logit of a text without features."""

    table: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        bucket, at = features(texts)
        counts = np.diff(at)
        logit = np.zeros(len(texts))
        some = counts > 0
        if some.any():
            logit[some] = np.add.reduceat(self.table[bucket].astype(np.float64), at[:-1][some]) / counts[some]
        return 1 / (1 + np.exp(-np.clip(logit + self.bias, -50, 50)))


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """Stochastic gradient descent over (buckets, counts, label); without two classes, the share of class 1 for all texts."""
    labels = np.array([y for *_, y in examples])
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), bias)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS))
    weights, offset = np.zeros((2, DIMENSIONS)), np.array([0.0, bias])
    steps, step = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            bucket, count, label = examples[i]
            rate = RATE * (1 - step / steps)
            step += 1
            if not len(bucket):
                continue
            part = count / count.sum()  # whole numbers until here: the sample takes half the room
            mean = part @ vectors[bucket]
            logits = weights @ mean + offset
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[label] -= 1
            back = error @ weights
            weights -= rate * np.outer(error, mean)
            # the share of a feature in a mean is small: vectors move by the whole gradient of the mean, spread over features
            vectors[bucket] -= rate * np.outer(part * len(bucket) ** 0.5, back)
    return Model((vectors @ (weights[1] - weights[0])).astype(np.float32), float(offset[1] - offset[0]))


def held_out(key: str) -> Column:
    """Whether a row's label is kept from training: crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out. Null labels and ids are left out; further columns
    of either table are not read. The sample is chosen from the labels alone, so only its documents are shuffled: of rows with one
    id, which are combined in each task before, the text with the smallest digest is taken."""
    known = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label")).where("id is not null and label in (0, 1)").where(~held_out("id"))
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen.distinct()), "id")
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            bucket, at = features(batch.column("text").to_pylist())
            found = [np.unique(bucket[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label").cast(pa.int32()), pa.array([b.astype(np.int32).tobytes() for b, _ in found], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())],
                ["id", "label", "bucket", "count"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(count, f"id {kind}, label int, bucket binary, count binary").toArrow()
    order = sorted(zip(*(found.column(c).to_pylist() for c in ("id", "label", "bucket", "count"))))
    return fit([(np.frombuffer(b, np.int32), np.frombuffer(c, np.int32), int(y)) for _, y, b, c in order])


def score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """All columns and the probability of class 1; a column of that name is replaced. Null and empty texts get the score of a text
    without features."""
    kept = [f.name for f in df.schema.fields if f.name != column]
    shared = df.sparkSession.sparkContext.broadcast(model)  # 0.5 MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(shared.value.scores(batch.column(text).to_pylist()))], [*kept, column])

    rows = df.select(*[F.col(f"`{c}`") for c in kept])
    return rows.mapInArrow(run, rows.withColumn(column, F.lit(0.0)).schema)

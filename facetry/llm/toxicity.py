"""Toxicity scores: FTRL-proximal logistic regression over hashed word features.

Features are words, pairs of neighbours, and pairs with one word between them
(skip-grams), hashed to ``DIMENSIONS`` indices and counted once per text.  FTRL-proximal runs over the training
sample with one learning rate per coordinate; L1 keeps nearly all weights at zero, so
the model that is broadcast is a few thousand pairs of index and weight (its bound is
the number of features in the bounded sample).  Gradients of toxic rows weigh
``POSITIVE`` times, because they are the rare ones.  With ``shards`` over 1 each shard
of the sample trains alone and the weights are averaged.

Rows of the training sample: labelled documents in the order of a hash of their id, at
most ``SAMPLE_ROWS``, and no further one once those before it have ``SAMPLE_FEATURES``
features, so that long texts do not make the sample large.  Scoring reads every text in full.

Empty and null texts get the score of a text without known features.  Labels that are
null or that have no document are ignored; of several labels of one id the largest
counts.  Without training rows every score is just below 0.5, predicted 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.kernels import (
    NOT_WORD, STEP, column_buffers, keep, mix, positions, scan, word_hashes,
)

BITS = 22
DIMENSIONS = 1 << BITS
SAMPLE_ROWS = 16_000
SAMPLE_FEATURES = 1 << 26
SHARDS = 1
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.5
POSITIVE = 5.0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature index and row of every n-gram occurrence of a batch."""
    starts, ends, rows = positions(offsets, data, NOT_WORD)
    words = word_hashes(data, starts, ends, lower=True)
    parts, owners = [words], [rows]
    for gap, salt in ((1, 0x51), (2, 0xA7)):
        m = max(0, len(words) - gap)
        ok = rows[:m] == rows[gap : gap + m]
        pair = words[:m] * STEP + words[gap : gap + m] + np.uint64(salt)
        parts.append(pair[ok])
        owners.append(rows[:m][ok])
    index = (mix(np.concatenate(parts)) >> np.uint64(64 - BITS)).astype(np.int64)
    return index, np.concatenate(owners)


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Features seen and their weights after ``epochs`` passes; the last coordinate is the intercept.

    Only features of the sample have coordinates, so that a small sample takes little memory.
    """
    used = np.zeros(DIMENSIONS + 1, bool)
    used[DIMENSIONS] = True
    for index in rows:
        used[index] = True
    names = np.flatnonzero(used)
    place = np.cumsum(used, dtype=np.int32) - 1
    z = np.zeros(len(names))
    n = np.zeros(len(names))

    def weights(zi, ni):
        return np.where(
            np.abs(zi) <= L1, 0.0,
            -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2),
        )

    for _ in range(epochs):
        for index, label in zip(rows, labels):
            index = np.append(place[index], len(names) - 1)
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            gradient = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (POSITIVE if label else 1)
            grown = ni + gradient * gradient
            z[index] = zi + gradient - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[index] = grown
    seen = np.flatnonzero(n)
    return names[seen], weights(z[seen], n[seen])


def train(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, shards: int = SHARDS,
    sample_features: int = SAMPLE_FEATURES,
) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero weights (index, value) from the labelled documents in ``labels`` (doc_id, toxic)."""
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .select("doc_id", "toxic", F.xxhash64("doc_id").alias("_order"))
        .orderBy("_order", "doc_id").limit(sample_rows)
    )
    # The sample has at most sample_rows rows, which bounds the broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def collect(batch):
        index, owner = features(*column_buffers(batch.column("text")))
        both = np.unique(owner * DIMENSIONS + index)
        cuts = np.searchsorted(both, np.arange(batch.num_rows + 1) * DIMENSIONS)
        values = pa.array((both % DIMENSIONS).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), batch.column("_order"),
             pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)],
            ["doc_id", "toxic", "_order", "features"],
        )

    sparse = scan(
        rows, ["doc_id", "toxic", "_order", "text"], collect,
        "doc_id long, toxic int, _order long, features array<int>",
    )

    def learnt(rows: list[np.ndarray], toxic: list[int]) -> pa.RecordBatch:
        feature, w = ftrl(rows, np.array(toxic, float))
        kept = np.flatnonzero(w)
        return pa.RecordBatch.from_arrays([pa.array(feature[kept]), pa.array(w[kept])], ["feature", "weight"])

    def fit(batches):
        """Weights of each shard; its rows come in order, in small batches, and are held once."""
        at, held, toxic = None, [], []
        for batch in batches:
            lists = batch.column("features")
            values = lists.values.to_numpy()
            offsets = lists.offsets.to_pylist()
            for i, (shard, label) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("toxic").to_pylist())):
                if shard != at and held:
                    yield learnt(held, toxic)
                    held, toxic = [], []
                at = shard
                held.append(values[offsets[i] : offsets[i + 1]])
                toxic.append(label)
        if held:
            yield learnt(held, toxic)
        del held, toxic
        pa.default_memory_pool().release_unused()

    # Stored once: the texts are read for their features, and the features for their number.
    sparse = keep(sparse.withColumn("shard", F.pmod(F.col("_order"), F.lit(shards))))
    before = Window.partitionBy("shard").orderBy("_order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    kept = (
        sparse.groupBy("shard", "_order", "doc_id").agg(F.sum(F.size("features")).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .where(F.col("_before") < sample_features).select("doc_id")
    )
    found = (
        sparse.join(F.broadcast(kept), "doc_id", "left_semi").select("shard", "_order", "doc_id", "toxic", "features")
        .repartition(shards, "shard").sortWithinPartitions("shard", "_order", "doc_id")
        .mapInArrow(fit, "feature long, weight double")
        .groupBy("feature").agg((F.sum("weight") / shards).alias("weight")).orderBy("feature").toPandas()
    )
    return found["feature"].to_numpy(np.int64), found["weight"].to_numpy(float)


class Weights:
    """Weights by feature: which are not zero, and those in order, in an eighth of a dense table."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray]):
        order = np.argsort(model[0], kind="stable")
        self.names, self.values = model[0][order], model[1][order]
        self.known = np.zeros(DIMENSIONS + 1, bool)
        self.known[self.names] = self.values != 0

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        """Weights of known features."""
        return self.values[np.searchsorted(self.names, index)]

    @property
    def intercept(self) -> float:
        return float(self.values[-1]) if self.known[DIMENSIONS] else 0.0


def margins(batch: pa.RecordBatch, weights: Weights) -> np.ndarray:
    """Log-odds of every text; the tiny offset makes a text without evidence not toxic."""
    index, owner = features(*column_buffers(batch.column("text")))
    known = weights.known[index]
    both = np.unique(owner[known] * DIMENSIONS + index[known])
    evidence = np.bincount(both // DIMENSIONS, weights[both % DIMENSIONS], batch.num_rows)
    return np.clip(evidence + weights.intercept - 1e-9, -35, 35)


def add_scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made: list[Weights] = []

    def score(batch):
        if not made:
            made.append(Weights(shared.value))
        p = 1 / (1 + np.exp(-margins(batch, made[0])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
            ["doc_id", "score", "predicted"],
        )

    return scan(docs, ["doc_id", "text"], score, "doc_id long, score double, predicted int")


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted``; rows of fold 0 are never learnt from.

    Neither are rows without an id, which count as held out.
    """
    model = train(docs, labels.where(fold(F.col("doc_id"), held_out) != 0))
    return add_scores(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), held_out) == 0, F.lit(True)).alias("held_out"), "score", "predicted"
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, unchanged.  Every label is learnt from."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    made: list[Weights] = []

    def clean(batch):
        if not made:
            made.append(Weights(shared.value))
        yield batch.filter(pa.array(margins(batch, made[0]) < 0))

    return scan(docs, docs.columns, clean, docs.schema)

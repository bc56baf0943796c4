"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features are the distinct words, neighbouring pairs and pairs one word apart,
hashed, and the words' stems, so that an unseen ending doesn't hide a word.
Shards of the labelled sample learn at the same time from a common state; after
each round their states are averaged. The L1 term leaves few weights, which are
broadcast to score every text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import linear
from sparkloom.llm import textvec as tv
from sparkloom.llm.common import written

BITS = 18
#: Bytes of the word beginnings that stand for a word's stem.
STEMS = (5, 6, 7, 8)
#: Rates and stems are those of least log loss on a fold of the training rows (remainder 1).
ALPHA, BETA, L1, L2 = 0.5, 1.0, 3.0, 0.1


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words, neighbouring pairs, pairs one word apart, and word stems of STEMS bytes."""
    buf, offsets = tv.column_bytes(texts)
    hs, docs, stems = [], [], []
    for h, doc, start, end, part in tv.words(buf, offsets, tv.ALNUM):
        hs.append(h), docs.append(doc)
        stems.append([tv.byte_hash(part, start, np.minimum(end, start + n)) for n in STEMS])
    if not hs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, doc = np.concatenate(hs), np.concatenate(docs)
    mask = (1 << BITS) - 1
    parts = [linear.chain(h, doc, steps, salt, mask) for salt, steps in enumerate(((0,), (0, 1), (0, 2)))]
    parts += [linear.chain(np.concatenate(stem), doc, (0,), 3 + k, mask) for k, stem in enumerate(zip(*stems, strict=True))]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of FTRL-proximal from its gradient sums ``z`` and squared sums ``n``."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(z: np.ndarray, n: np.ndarray, rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """One pass over the rows; changes ``z`` and ``n``. The last entry is the bias."""
    touched = np.zeros(len(z), bool)
    bias = len(z) - 1
    for features, label in rows:
        i = np.append(features, bias)
        w = weights_of(z[i], n[i])
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -40, 40)))
        g = p - label
        s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
        z[i] += g - s * w
        n[i] += g * g
        touched[i] = True
    return np.flatnonzero(touched)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of a shard's documents each feature is."""
    for batch in batches:
        for rows in linear.unpacked(batch):
            n = np.bincount(np.concatenate([x for x, _ in rows]), minlength=1 << BITS)
            feature = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(feature.astype(np.int32)), pa.array(n[feature])], names=["feature", "n"])


def _trainer(state: Broadcast, known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each shard's pass from the common state: what it changed, by bucket."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old_z, old_n = state.value
        for batch in batches:
            for rows in linear.unpacked(batch):
                z, n = old_z.copy(), old_n.copy()
                at = learn(z, n, [(x[known.value[x]], label) for x, label in rows])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, z[at] - old_z[at], n[at] - old_n[at])], names=["bucket", "z", "n"])

    return train


def fit(docs: DataFrame, labels: DataFrame, bound: int = 8192, shards: int = 4, rounds: int = 4, min_docs: int = 4) -> np.ndarray:
    """Weights (``2**BITS`` features, then the bias) from at most ``bound`` labelled rows.

    Features in fewer than ``min_docs`` sampled documents have no weight and
    never reach the driver. The features are shuffled once, into a table with a
    row a shard; a round reads it and shuffles what the shards changed.
    """
    spark = docs.sparkSession
    sample = linear.labelled_sample(labels, "toxic", bound)
    rows = written(linear.packed(linear.training_rows(docs, sample, word_features, BITS, shards)), "toxic-shards")
    counts = rows.mapInArrow(_counted, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    kept = np.zeros(1 << BITS, bool)
    kept[counts.where(F.col("n") >= min_docs).select("feature").toPandas()["feature"].to_numpy(dtype=np.int64)] = True
    known = spark.sparkContext.broadcast(kept)
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((z, n))

        moved = rows.mapInArrow(_trainer(state, known), "bucket long, z double, n double")
        # a bucket's change is averaged over the shards that saw it
        mean = moved.groupBy("bucket").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toPandas()
        at = mean["bucket"].to_numpy(dtype=np.int64)
        z[at] += mean["z"].to_numpy()
        n[at] += mean["n"].to_numpy()
    return weights_of(z, n)


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: int = 8192, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    The model is fitted when the function is called, on at most ``bound`` rows
    of ``labels(doc_id, toxic)`` outside the held-out fold; without any, every
    score is 0.5. Empty and null texts get the score of no feature. Columns
    named score or predicted are replaced; repeated rows are scored alike. A
    very long text is scored whole, in blocks; an empty table stays empty.
    """
    w = fit(docs, labels, bound)
    bias = w[-1]
    out = linear.scored(docs, w[:-1], word_features, lambda s: linear.sigmoid(s + bias))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

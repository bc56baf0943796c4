"""Quality by naive Bayes support vectors.

Indicators of n-grams, over words and over word shapes, are scaled by their
class log-count ratios; a linear hinge-loss model is then fitted by dual
coordinate descent (Wang and Manning, 2012; Hsieh et al., 2008). Shards of the
labelled sample fit at the same time and their weights are averaged; Platt's
scaling turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import linear
from sparkloom.llm import textvec as tv
from sparkloom.llm.common import written

BITS = 20
COST, EPOCHS = 0.1, 8

_KIND = np.zeros(256, np.uint16)
_KIND[33:127] = 32
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 8
for _c in b".,;:?'":
    _KIND[_c] = 16


def shape_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words, word pairs, and one to three shapes in a row.

    A shape holds which kinds of characters a word has, whether it begins with
    a capital, its length in three steps, and whether it repeats the word before.
    """
    buf, offsets = tv.column_bytes(texts)
    hs, docs, shapes = [], [], []
    for h, doc, start, end, part in tv.words(buf, offsets, tv.NOT_SPACE, lower=False):
        kinds = np.bitwise_or.reduceat(_KIND[part], start)
        kinds |= ((part[start] >= 65) & (part[start] <= 90)).astype(np.uint16) << 6
        kinds |= (np.minimum(end - start, 15) >> 2).astype(np.uint16) << 7
        hs.append(h), docs.append(doc), shapes.append(kinds)
    if not hs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, doc, shape = np.concatenate(hs), np.concatenate(docs), np.concatenate(shapes)
    shape[1:] |= ((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])).astype(np.uint16) << 9
    s = tv.mix(shape.astype(np.uint64) + np.uint64(1))
    mask = (1 << BITS) - 1
    parts = [linear.chain(h, doc, steps, salt, mask) for salt, steps in enumerate(((0,), (0, 1)))]
    parts += [linear.chain(s, doc, steps, salt, mask) for salt, steps in ((7, (0,)), (8, (0, 1)), (9, (0, 1, 2)))]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, seed: int) -> np.ndarray:
    """Weights of ``min |w|^2 / 2 + COST * sum(hinge)``; x has r at its features and 1 for the bias (last)."""
    w, alpha = np.zeros(len(r) + 1), np.zeros(len(rows))
    norms = np.array([np.dot(r[x], r[x]) + 1.0 for x in rows])
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            g = y[i] * (np.dot(w[x], r[x]) + w[-1]) - 1.0
            new = min(max(alpha[i] - g / norms[i], 0.0), COST)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * r[x]
                w[-1] += step
                alpha[i] = new
    return w


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """``a, b`` of ``sigmoid(a * margin + b)`` by Newton's method on smoothed targets."""
    up, down = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = linear.sigmoid(a * margin + b)
        d, v = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([np.dot(d, margin), d.sum()])
        m = np.array([[np.dot(v * margin, margin) + 1e-6, np.dot(v, margin)], [np.dot(v, margin), v.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, bound: int = 8192, shards: int = 4, min_docs: int = 5) -> tuple[np.ndarray, float, float, float]:
    """Weights of the features, bias, and Platt's ``a, b``, from at most ``bound`` labelled rows.

    Features in fewer than ``min_docs`` sampled documents have no weight.
    """
    spark = docs.sparkSession
    sample = linear.labelled_sample(labels, "quality", bound)
    rows = written(linear.training_rows(docs, sample, shape_features, BITS, shards), "quality-rows")
    counts = rows.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("label").alias("up")).where(F.col("n") >= min_docs).toPandas()
    r = np.zeros(1 << BITS)
    up, n = counts["up"].to_numpy(dtype=float), counts["n"].to_numpy(dtype=float)
    p, q = 1 + up, 1 + n - up
    if len(counts):
        r[counts["feature"].to_numpy()] = np.log((p / p.sum()) / (q / q.sum()))
    ratios = spark.sparkContext.broadcast(r)

    def train(part: pa.Table) -> pa.Table:
        r = ratios.value
        rows = linear.examples(part)
        w = dual_descent([x[r[x] != 0] for x, _ in rows], np.array([1.0 if label > 0 else -1.0 for _, label in rows]), r, part["shard"][0].as_py())
        at = np.flatnonzero(w)
        return pa.table({"feature": at, "w": w[at]})

    fitted = rows.groupBy("shard").applyInArrow(train, "feature long, w double")
    w = np.zeros((1 << BITS) + 1)
    mean = fitted.groupBy("feature").agg((F.sum("w") / shards).alias("w")).toPandas()
    w[mean["feature"].to_numpy(dtype=np.int64)] = mean["w"].to_numpy()
    bias, w = w[-1], w[:-1] * r
    sent = spark.sparkContext.broadcast(w)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [float(sent.value[x.values.to_numpy()].sum()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.float64()), batch.column(1)], names=["m", "label"])

    seen = rows.select("features", "label").mapInArrow(margins, "m double, label int").toPandas()
    a, b = platt(seen["m"].to_numpy() + bias, seen["label"].to_numpy()) if len(seen) else (1.0, 0.0)
    return w, float(bias), a, b


def score_quality(docs: DataFrame, labels: DataFrame, bound: int = 8192, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    The model is fitted when the function is called, on at most ``bound`` rows
    of ``labels(doc_id, quality)`` outside the held-out fold; without any, every
    score is 0.5. Empty and null texts get the score of no feature. Columns
    named score or predicted are replaced; repeated rows are scored alike. A
    very long text is scored whole, in blocks; an empty table stays empty.
    """
    w, bias, a, b = fit(docs, labels, bound)
    out = linear.scored(docs, w, shape_features, lambda s: linear.sigmoid(a * (s + bias) + b))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

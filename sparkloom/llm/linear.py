"""What the two linear text classifiers share: labels, hashed features, scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textvec as tv

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Bytes of texts whose features are in memory at once.
SLICE = 1 << 18
Features = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def labelled_sample(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """``doc_id, label`` of at most ``bound`` labelled rows outside the held-out fold.

    The rows of least hash, so the sample is the same in every run. Null labels
    and ids are left out; of several labels of a document the largest counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def chain(h: np.ndarray, doc: np.ndarray, steps: tuple[int, ...], salt: int, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words at ``i + steps`` within a text, and the texts' numbers."""
    reach = steps[-1]
    if len(h) <= reach:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(h) - reach
    total = np.full(n, salt, np.uint64)
    for k, step in enumerate(steps):
        total = tv.mix(total + h[step : step + n] * _C[k % 3])
    inside = doc[:n] == doc[reach:]
    return doc[:n][inside], (total[inside] & np.uint64(mask)).astype(np.int64)


def distinct(doc: np.ndarray, feature: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(doc.astype(np.int64) << bits | feature)
    return key >> bits, key & ((1 << bits) - 1)


def training_rows(docs: DataFrame, sample: DataFrame, features: Features, bits: int, shards: int) -> DataFrame:
    """``doc_id, label, shard, features`` of the sampled documents: distinct feature numbers.

    The sample is bounded by its own limit, so it is broadcast, and only its
    texts are shuffled. Of rows with the same doc_id the least text counts, so
    repeated rows train once.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tv.slices(batch.column(3), SLICE):
                doc, feature = distinct(*features(batch.column(3).slice(a, b - a)), bits)
                starts = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), lists], names=["doc_id", "label", "shard", "features"])

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    joined = joined.select(F.col("doc_id").cast("long").alias("doc_id"), "label", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), "text")
    return joined.mapInArrow(parse, "doc_id long, label int, shard int, features array<int>")


def examples(part: pa.Table) -> list[tuple[np.ndarray, int]]:
    """A shard's rows ``(features, label)`` in the order of their doc_id."""
    part = part.sort_by("doc_id").combine_chunks()
    lists = part["features"].combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
    return list(zip(np.split(flat, ends[:-1]), part["label"].to_pylist(), strict=True))


def packed(rows: DataFrame) -> DataFrame:
    """``shard, labels, sizes, features`` of :func:`training_rows`: a shard as one row, its documents in the order of their doc_id.

    What is trained in rounds reads these and shuffles no features again.
    """

    def whole(values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(pa.int32()))

    def pack(part: pa.Table) -> pa.Table:
        part = part.sort_by("doc_id").combine_chunks()
        lists = part["features"].combine_chunks()
        return pa.table({"shard": part["shard"][:1], "labels": whole(part["label"].combine_chunks()), "sizes": whole(lists.value_lengths()), "features": whole(lists.flatten())})

    return rows.groupBy("shard").applyInArrow(pack, "shard int, labels array<int>, sizes array<int>, features array<int>")


def unpacked(batch: pa.RecordBatch) -> Iterator[list[tuple[np.ndarray, int]]]:
    """The rows ``(features, label)`` of each shard that :func:`packed` made."""
    for k in range(batch.num_rows):
        labels, sizes, flat = (batch.column(c)[k].values.to_numpy() for c in ("labels", "sizes", "features"))
        yield list(zip(np.split(flat, np.cumsum(sizes)[:-1]), labels.tolist(), strict=True))


def scored(docs: DataFrame, weights: np.ndarray, features: Features, link: Callable[[np.ndarray], np.ndarray], column: str = "score") -> DataFrame:
    """``docs`` with ``link(sum of the weights of a text's distinct features)``.

    Only features with a weight are made distinct; the rest add nothing.
    """
    spark, names = docs.sparkSession, [c for c in docs.columns if c != column]
    bits = len(weights).bit_length() - 1
    sent = spark.sparkContext.broadcast(weights)
    at = names.index("text")
    out = docs.select(*names).withColumn(column, F.lit(0.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            texts, parts = batch.column(at), [np.zeros(0)]
            for a, b in tv.slices(texts, SLICE):
                doc, feature = features(texts.slice(a, b - a))
                weighty = w[feature] != 0
                doc, feature = distinct(doc[weighty], feature[weighty], bits)
                parts.append(np.bincount(doc, weights=w[feature], minlength=b - a))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(link(np.concatenate(parts)))], names=batch.schema.names)

    return out.mapInArrow(score, out.schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))

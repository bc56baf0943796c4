"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents lie, in an order drawn by hash, on a line of words that
is cut into blocks; the mix takes a source's first blocks, up to its target,
and begins the line anew where the target is longer. Which blocks go to which
output shard is a random deal without replacement. It is made by a tree over
the shards: a node holds how many blocks of each source lie in it, and its left
half gets a multivariate-hypergeometric draw of them, the right half the rest;
so the quotas stay exact at every node. A node's draw depends on its place and
the seed alone, so a task works out the path to its own shards and no more. A
shard's blocks are the next ones of a permuted order, disjoint from all other
shards', and are shuffled within the shard.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm import textvec as tv
from sparkloom.llm.common import temporary, written
from sparkloom.operators.ranking import numbered

#: Weights of the sources in order, repeating; no target exceeds MOST times its source.
WEIGHTS, MOST = (5, 2, 1), 3
#: Words of an output shard, the least number of shards, and the blocks of a shard.
SHARD_WORDS, LEAST_SHARDS, SHARD_BLOCKS = 1 << 20, 8, 64
#: All blocks of a mix at most; beyond it blocks grow. Sources share a line where there are more than LINES.
MOST_BLOCKS, LINES = 400_000_000, 1024
SEED = 17


def word_counts(column: pa.Array) -> np.ndarray:
    """Words (runs without ASCII white space) of each text, read in blocks."""
    buf, offsets = tv.column_bytes(column)
    counts = np.zeros(len(column), np.int64)
    for at, end in tv.blocks(buf, offsets, tv.NOT_SPACE):
        inside = tv.NOT_SPACE[buf[at:end]]
        cuts = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        starts[cuts] = inside[cuts]
        where = np.flatnonzero(starts) + at
        counts += np.bincount(np.searchsorted(offsets, where, side="right") - 1, minlength=len(counts))
    return counts


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` of each row; a null text has size 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tv.slices(batch.column(2)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(word_counts(part.column(2)))], names=["doc_id", "source", "size"])

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, rows.drop("text").schema.add("size", "long"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sources(source, source_size)`` with ``rank`` (by code point, null last) and ``target``.

    Targets share all words by weight; one that would exceed ``most`` times its
    source stops there, and what it leaves is shared by the rest again, until
    none is above. Only sums over the sources reach the driver.
    """
    ranked = written(numbered(sources, [], [F.col("source").asc_nulls_last()], "rank"), "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    held = ranked.withColumn("weight", weight)
    cap = F.lit(float(most)) * F.col("source_size")
    everything = held.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    level, before = (everything["words"] or 0) / (everything["weight"] or 1.0), -1
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        seen = held.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count_if(full).alias("n")).first()
        if seen["n"] == before or not seen["open"]:
            break
        level, before = (everything["words"] - seen["full"]) / seen["open"], seen["n"]
    return held.select("source", "source_size", "rank", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def capacity(total: int, shards: int, low: int, high: int) -> int:
    """Blocks of the shards from ``low`` to ``high``: they differ by one at most."""
    return total * high // shards - total * low // shards


def split(quotas: np.ndarray, starts: np.ndarray, low: int, high: int, shards: int, seed: int, wanted: tuple[int, int], total: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(shard, starts, counts)`` of the wanted shards below a node of the tree: each line's blocks from ``starts``, ``counts`` of them."""
    if high - low == 1:
        yield low, starts, quotas
        return
    mid = (low + high) // 2
    draw = np.random.default_rng([seed, low, high])
    left = draw.multivariate_hypergeometric(quotas, capacity(total, shards, low, mid), method="marginals")
    if wanted[0] < mid:
        yield from split(left, starts, low, mid, shards, seed, wanted, total)
    if wanted[1] > mid:
        yield from split(quotas - left, starts + left, mid, high, shards, seed, wanted, total)


def shard_plan(spark, quotas: list[int], shards: int, seed: int = SEED) -> DataFrame:
    """``line, shard, first, n``: the blocks, in permuted order, that a shard takes of each line."""
    total = sum(quotas)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = np.array(quotas, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            for shard, starts, counts in split(root, np.zeros_like(root), 0, shards, shards, seed, (int(ids.min()), int(ids.max()) + 1), total):
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), shard)), pa.array(starts[some]), pa.array(counts[some])], names=["line", "shard", "first", "n"])

    return spark.range(shards).mapInArrow(plan, "line long, shard long, first long, n long")


def permutation(size: int, seed: int) -> tuple[int, int]:
    """``a, b`` of the permutation ``x -> (a x + b) mod size``."""
    draw = random.Random(seed)
    a = draw.randrange(1, size + 1)
    while math.gcd(a, size) > 1:
        a = draw.randrange(1, size + 1)
    return a, draw.randrange(size)


def _corrected(seated: DataFrame, most: int) -> DataFrame:
    """``seated`` with ``times``: how often each row is taken.

    As often as its middle lies before the target; then one row of each source
    is taken once more or once less, that which brings the source nearest to its target.
    """
    middle = F.col("start") + F.col("size") / 2
    rows = seated.withColumn("times", F.greatest(F.lit(0), F.least(F.lit(most), F.floor((F.col("target") - middle) / F.col("source_size")) + 1)).cast("int"))
    over = rows.groupBy("source").agg((F.sum(F.col("times") * F.col("size")) - F.first("target")).alias("over")).withColumnRenamed("source", "of_source")
    open_ = rows.join(over, rows["source"].eqNullSafe(over["of_source"]))
    off = F.abs("over")
    can = (F.col("size") < 2 * off) & F.when(F.col("over") > 0, F.col("times") > 0).otherwise(F.col("times") < most)
    change = open_.where(can).groupBy(F.col("source").alias("of_source")).agg(F.min(F.struct(F.abs(F.col("size") - off).alias("left"), F.col("start").alias("of_start"), (-F.signum("over")).alias("by"))).alias("c"))
    change = change.select("of_source", "c.of_start", F.col("c.by").cast("int").alias("by"))
    joined = rows.join(change, rows["source"].eqNullSafe(change["of_source"]) & (rows["start"] == change["of_start"]), "left")
    return joined.select(*[rows[c] for c in seated.columns], (F.col("times") + F.coalesce("by", F.lit(0))).alias("times"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, shard_words: int = SHARD_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs(doc_id, source, text, ...)`` as they lie on their sources' lines, and the mix.

    Rows: ``doc_id, source, size, source_size, target, start``; ``start`` is the
    first word's place on the line and, with the source, names a row that has
    words. Mix: ``shard, place, source, start, round, doc_id, size``, a row for
    each time a document is taken, in the order of each shard.

    A document is taken as often as its middle lies before the target, and one
    of each source is taken once more or less where that brings the source's
    words nearer to it; so they miss it by half a document at most, and no
    document is taken more than ``most`` times. A null text has no words and is never taken;
    repeated rows and null ids are rows of their own; null sources are one
    source, the last; an empty table gives empty results; a very long text is
    one document, read in blocks. Other columns are not read.
    """
    spark = docs.sparkSession
    with temporary() as keep:
        rows = written(sized(docs), "mix-rows")
        found = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
        seen = found.agg(F.sum("source_size").alias("words"), F.count("*").alias("n")).first()
        words, n = seen["words"] or 0, seen["n"]
        shards = max(LEAST_SHARDS, -(-words // shard_words))
        block = max(1.0, words / min(MOST_BLOCKS, shards * SHARD_BLOCKS))
        quota = F.when(F.col("target") > 0, F.greatest(F.lit(1), F.round(F.col("target") / block))).otherwise(0).cast("long")
        per_line = max(1, -(-n // LINES))
        found = found.withColumns({"quota": quota, "line": F.floor(F.col("rank") / per_line)})
        earlier = Window.partitionBy("line").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        found = written(found.withColumn("offset", F.coalesce(F.sum("quota").over(earlier), F.lit(0))), "mix-quotas")
        of_line = {r["line"]: r["quota"] for r in found.groupBy("line").agg(F.sum("quota").alias("quota")).collect()}  # LINES rows at most
        quotas = [of_line[k] for k in range(len(of_line))]

        turn = F.xxhash64("doc_id", "size", F.lit(seed))
        seated = numbered(rows.where("size > 0"), ["source"], [turn, "doc_id", "size"], "start", mass="size", label="mix-seated")
        seated = seated.union(rows.where("size = 0").withColumn("start", F.lit(None).cast("long")))
        named = found.withColumnRenamed("source", "of_source")
        seated = seated.join(named, seated["source"].eqNullSafe(named["of_source"])).drop("of_source")
        seated = keep(written(seated, "mix-lines"))

        taken = _corrected(seated.where("start is not null and quota > 0"), most)
        rounds = F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("round")
        taken = taken.where("times > 0").select("source", "source_size", "start", "doc_id", "size", "line", "offset", "quota", "target", rounds)
        middle = F.col("round") * F.col("source_size") + F.col("start") + F.col("size") / 2
        width = F.col("target") / F.col("quota")
        at = F.col("offset") + F.least(F.floor(middle / width), F.col("quota") - 1)
        taken = taken.select("source", "start", "doc_id", "size", "line", "round", at.alias("at"))
        moves = [(k, *permutation(q, seed + k), q) for k, q in enumerate(quotas) if q]
        moves = spark.createDataFrame(moves, "line long, a long, b long, of long")
        taken = taken.join(F.broadcast(moves), "line").withColumn("at", (F.col("at") * F.col("a") + F.col("b")) % F.col("of"))
        plan = shard_plan(spark, quotas, shards, seed).select("line", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("at"))
        shuffled = Window.partitionBy("shard").orderBy(F.xxhash64("source", "start", "round", F.lit(seed)), "source", "start", "round")
        out = taken.join(plan, ["line", "at"]).withColumn("place", F.row_number().over(shuffled).cast("long") - 1)
        out = keep(written(out.select("shard", "place", "source", "start", "round", "doc_id", "size"), "mix"))
    return seated.select("doc_id", "source", "size", "source_size", "target", "start"), out


def taken_words(rows: DataFrame, mixed: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each row: the words that the mix takes, repeats counted."""
    times = mixed.groupBy(F.col("source").alias("of_source"), F.col("start").alias("of_start")).agg(F.count("*").alias("times"))
    same = rows["source"].eqNullSafe(times["of_source"]) & (rows["start"] == times["of_start"])
    return rows.join(times, same, "left").select("doc_id", "size", "source_size", "target", (F.coalesce("times", F.lit(0)) * F.col("size")).alias("taken"))


def mixed_texts(mixed: DataFrame, docs: DataFrame) -> DataFrame:
    """The mix with the other columns of ``docs``, whose doc_ids must be unique and not null."""
    others = [c for c in docs.columns if c != "doc_id" and c.lower() not in {x.lower() for x in mixed.columns}]
    return mixed.join(docs.select("doc_id", *others), "doc_id")

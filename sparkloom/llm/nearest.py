"""Nearest vectors by vantage-point trees, one for each shard.

Largest inner product is turned into smallest distance: with M the largest norm
of all vectors, x becomes (x, sqrt(M^2 - |x|^2)) and a query (q, 0). Then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, a metric, so the triangle inequality prunes.

A top tree, built of a bounded sample, deals all vectors to shards that lie
together. A query is searched in its own shard first; how far its neighbours
are there tells which other shards can hold nearer ones, and only those get it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import temporary, written

LEAF = 256
#: Vectors that the top tree is built of, and its leaves, at most; a leaf of many vectors is dealt on by hash.
SAMPLE, TOP_LEAVES = 4096, 1024
#: Pairs that are worked out at once.
PAIRS = 1 << 16


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows in double precision, summed from the first component to the last."""
    return np.cumsum(q * x, axis=1)[:, -1] if q.shape[1] else np.zeros(len(q))


def augmented(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0.0))[:, None]])


def distances(x: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    diff = x - vantage
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


class VantagePointTree:
    """A tree over rows of ``x``; ``search`` takes many queries at once.

    A node keeps a vantage point and the median distance of its rows from it;
    nearer rows go inside. A side is skipped when its least possible distance
    exceeds ``factor`` times the distance of the worst neighbour found so far:
    1 is exact, smaller factors skip more.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 7, top: float | None = None):
        self.x = np.ascontiguousarray(x, dtype=np.float64)
        self.top = np.einsum("ij,ij->i", self.x, self.x).max(initial=0.0) if top is None else top
        self.aug = augmented(self.x, self.top)
        self.leaf, self.rng = leaf, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(self.x)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        vantage = self.aug[rows[self.rng.integers(len(rows))]]
        dist = distances(self.aug[rows], vantage)
        order = np.argsort(dist, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        # the bounds of each side, so that ties at the median may fall on both
        return vantage, (dist[near[0]], dist[near[-1]]), (dist[far[0]], dist[far[-1]]), self._build(rows[near]), self._build(rows[far])

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores (queries x k), largest inner product first; -1 where rows are fewer.

        Of rows with equal scores the smaller numbers come first.
        """
        self._q = np.ascontiguousarray(queries, dtype=np.float64)
        self._aug_q = np.hstack([self._q, np.zeros((len(self._q), 1))])
        self._norm = np.einsum("ij,ij->i", self._q, self._q)
        # rounding of a matrix product is far below this
        self._slack = 1e-12 * np.sqrt(self._norm * self.top)
        self._best = np.full((len(self._q), k), -np.inf)
        self._rows = np.full((len(self._q), k), -1, dtype=np.int64)
        self._visit(self.root, np.arange(len(self._q)), k, factor)
        return self._rows, self._best

    def _reach(self, which: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self._norm[which] + self.top - 2 * self._best[which, -1], 0.0))

    def _leaf(self, node: np.ndarray, which: np.ndarray, k: int) -> None:
        """Rows of a leaf that can be among the best by a matrix product are scored exactly and merged."""
        step = max(1, PAIRS // max(1, len(node)))
        for a in range(0, len(which), step):
            part = which[a : a + step]
            rough = self._q[part] @ self.x[node].T
            floor = self._best[part, -1]
            if len(node) >= k:
                floor = np.maximum(floor, np.partition(rough, len(node) - k, axis=1)[:, len(node) - k] - self._slack[part])
            qi, xi = np.nonzero(rough >= (floor - self._slack[part])[:, None])
            score = inner(self._q[part[qi]], self.x[node[xi]])
            old = np.repeat(np.arange(len(part)), k)
            owner = np.concatenate([old, qi])
            score = np.concatenate([self._best[part].ravel(), score])
            row = np.concatenate([self._rows[part].ravel(), node[xi]])
            # empty places last among equal scores
            order = np.lexsort((np.where(row < 0, len(self.x), row), -score, owner))
            owner = owner[order]
            kept = order[np.arange(len(owner)) - np.searchsorted(owner, owner) < k]
            self._best[part], self._rows[part] = score[kept].reshape(-1, k), row[kept].reshape(-1, k)

    def _visit(self, node, which: np.ndarray, k: int, factor: float) -> None:
        if not len(which):
            return
        if isinstance(node, np.ndarray):
            if len(node):
                self._leaf(node, which, k)
            return
        vantage, near, far, inside, outside = node
        dist = distances(self._aug_q[which], vantage)
        inner_ = dist <= (near[1] + far[0]) / 2
        for chosen, first, second, bound in ((inner_, inside, outside, far), (~inner_, outside, inside, near)):
            part, away = which[chosen], dist[chosen]
            self._visit(first, part, k, factor)
            gap = np.maximum(np.maximum(bound[0] - away, away - bound[1]), 0.0)
            self._visit(second, part[gap <= factor * self._reach(part) + 1e-9], k, factor)


class TopTree:
    """Deals vectors to leaves that lie together; built of a sample, so no leaf's size is certain."""

    def __init__(self, sample: np.ndarray, leaves: int, top: float):
        self.top, self.depth = top, max(0, int(leaves - 1).bit_length())
        self.vantage: dict[tuple[int, int], tuple[np.ndarray, float]] = {}
        rng = np.random.default_rng(11)

        def split(rows: np.ndarray, level: int, number: int) -> None:
            if level == self.depth:
                return
            vantage = rows[rng.integers(len(rows))] if len(rows) else np.zeros(sample.shape[1] + 1)
            dist = distances(rows, vantage)
            cut = float(np.median(dist)) if len(rows) else 0.0
            self.vantage[level, number] = vantage, cut
            split(rows[dist <= cut], level + 1, 2 * number)
            split(rows[dist > cut], level + 1, 2 * number + 1)

        split(augmented(sample, top), 0, 0)

    def route(self, aug: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's leaf, and its distances from the vantage points on the way (rows x depth)."""
        leaf, away = np.zeros(len(aug), np.int64), np.zeros((len(aug), self.depth))
        for level in range(self.depth):
            before = leaf.copy()
            for number in np.unique(before):
                rows = np.flatnonzero(before == number)
                vantage, cut = self.vantage[level, int(number)]
                away[rows, level] = distances(aug[rows], vantage)
                leaf[rows] = 2 * number + (away[rows, level] > cut)
        return leaf, away

    def gaps(self, aug: np.ndarray, bounds: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The leaves, and how near each could have a vector to each row (rows x leaves), from the least and largest distances of its vectors."""
        leaves = np.array(sorted(bounds), np.int64)
        out = np.zeros((len(aug), len(leaves)))
        seen: dict[tuple[int, int], np.ndarray] = {}
        for c, leaf in enumerate(leaves):
            for level in range(self.depth):
                key = level, int(leaf) >> (self.depth - level)
                if key not in seen:
                    seen[key] = distances(aug, self.vantage[key][0])
                low, high = bounds[int(leaf)][0][level], bounds[int(leaf)][1][level]
                out[:, c] = np.maximum(out[:, c], np.maximum(low - seen[key], seen[key] - high))
        return leaves, out


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` without null, zero or non-finite vectors and null ids, of the commonest length."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(F.coalesce(x, F.lit(float("nan")))) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0))
    lengths = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return v.where(F.size("embedding") == (lengths[0]["d"] if lengths else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _searched(vectors: DataFrame, queries: DataFrame, k: int, factor: float, top: float) -> DataFrame:
    """``query_id, vec_id, score``: the ``k`` best of each part for each of its queries.

    ``vectors(leaf, sub, embedding, ids)`` and ``queries(leaf, sub, block, vec_id,
    embedding)``; each part and block is one bounded task. A part's tree is made
    in each of its tasks, which costs little beside the block's products.
    """
    keep = k + 1
    blocks = queries.select(F.col("leaf").alias("at_leaf"), F.col("sub").alias("at_sub"), F.col("block").alias("at_block")).distinct()
    left = vectors.join(blocks, (F.col("leaf") == F.col("at_leaf")) & (F.col("sub") == F.col("at_sub"))).select("at_leaf", "at_sub", "at_block", "embedding", "ids")

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if shard.num_rows and block.num_rows:
            # numbered by their least ids, which decide ties
            least = np.array([i[0] for i in shard["ids"].to_pylist()])
            shard = shard.take(pa.array(np.argsort(least, kind="stable")))
            x, q = _matrix(shard["embedding"]), _matrix(block["embedding"])
            names = block["vec_id"].to_numpy()
            rows, scores = VantagePointTree(x, top=top).search(q, min(keep, len(x)), factor)
            lists = shard["ids"].combine_chunks()
            flat, starts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            qi, xi, score = np.repeat(np.arange(len(q)), rows.shape[1]), rows.ravel(), scores.ravel()
            qi, xi, score = qi[xi >= 0], xi[xi >= 0], score[xi >= 0]
            n = np.diff(starts)[xi]
            qi, score = np.repeat(qi, n), np.repeat(score, n)
            ends = np.cumsum(n)
            vec = flat[np.arange(len(qi)) - np.repeat(ends - n, n) + np.repeat(starts[xi], n)]
            other = vec != names[qi]
            qi, vec, score = qi[other], vec[other], score[other]
            order = np.lexsort((vec, -score, qi))
            qi, vec, score = qi[order], vec[order], score[order]
            first = np.searchsorted(qi, qi)
            best = np.arange(len(qi)) - first < k
            out = [names[qi[best]], vec[best], score[best]]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), out, strict=True)))

    return left.groupBy("at_leaf", "at_sub", "at_block").cogroup(queries.groupBy("leaf", "sub", "block")).applyInArrow(search, "query_id long, vec_id long, score double")


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, shard_rows: int = 8192, query_rows: int = 4096
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors of largest inner product.

    Both inputs are ``(vec_id, embedding)``; extra columns are not read. Vectors
    that are null, zero, of another length, or hold null or non-finite components
    take no part. A query's own vec_id is no candidate; ties go to the smaller
    vec_id; a vec_id with several query vectors uses the least. Equal vectors
    are folded to one with its ``k + 1`` smallest ids, which is all that a
    result can hold, so a vector in a third of the rows costs one row. Empty
    tables give an empty result.

    A factor of 1 is exact: neighbours are chosen, and ties found, by the very
    scores that are returned.
    """
    with temporary() as keep:
        return keep(_nearest_neighbours(vectors, queries, k, factor, shard_rows, query_rows))


def _nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int, factor: float, shard_rows: int, query_rows: int) -> DataFrame:
    spark, keep = vectors.sparkSession, k + 1
    ids = F.slice(F.array_sort(F.array_distinct(F.collect_list("vec_id"))), 1, keep)
    folded = written(
        usable(vectors).groupBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(256)).alias("salt")).agg(ids.alias("ids"))
        .groupBy("embedding").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")), "vectors",
    )
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    n, top = folded.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(0.0))).first()
    leaves = 1 << max(0, min(TOP_LEAVES, -(-n // shard_rows)) - 1).bit_length()
    sample = _matrix(folded.orderBy(F.xxhash64("embedding")).limit(SAMPLE).select("embedding").toArrow()["embedding"]) if leaves > 1 else np.zeros((0, 0))
    tree = spark.sparkContext.broadcast(TopTree(sample, leaves, top))
    depth = tree.value.depth

    def dealt(batches):
        for batch in batches:
            if batch.num_rows:
                leaf, away = tree.value.route(augmented(_matrix(batch.column(0)), top)) if depth else (np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 0)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * depth), pa.array(away.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), lists], names=[*batch.schema.names, "leaf", "away"])

    rows = written(folded.select("embedding", "ids").mapInArrow(dealt, "embedding array<double>, ids array<long>, leaf long, away array<double>"), "dealt-vectors")
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("n"), *[f(F.get("away", F.lit(level))).alias(f"{name}{level}") for level in range(depth) for name, f in (("low", F.min), ("high", F.max))])
    sizes = sizes.collect()  # at most TOP_LEAVES rows
    subs = {r["leaf"]: max(1, -(-r["n"] // shard_rows)) for r in sizes}
    bounds = {r["leaf"]: (np.array([r[f"low{i}"] for i in range(depth)]), np.array([r[f"high{i}"] for i in range(depth)])) for r in sizes}
    table = spark.createDataFrame([(int(leaf), int(s)) for leaf, s in subs.items()], "leaf long, subs long")
    # one part in which all vectors of a leaf are that fit a task
    parts = rows.join(F.broadcast(table), "leaf").select("leaf", F.pmod(F.xxhash64("embedding"), F.col("subs")).alias("sub"), "embedding", "ids")

    def homes(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = tree.value.route(augmented(_matrix(batch.column(1)), top))[0] if depth else np.zeros(batch.num_rows, np.int64)
                known = np.array(sorted(bounds), np.int64)
                # a leaf without vectors is nobody's home
                leaf = known[np.minimum(np.searchsorted(known, leaf), len(known) - 1)] if len(known) else leaf
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["vec_id", "embedding", "leaf"])

    def blocked(df: DataFrame) -> DataFrame:
        """To all parts of their leaf, in blocks of about ``query_rows``."""
        groups = df.groupBy("leaf").agg(F.ceil(F.count("*") / query_rows).cast("long").alias("groups"))
        out = df.join(groups, "leaf").join(F.broadcast(table), "leaf")
        return out.select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1)).alias("sub"), F.pmod(F.xxhash64("vec_id"), F.col("groups")).alias("block"), "vec_id", "embedding")

    first = written(asked.select("vec_id", "embedding").mapInArrow(homes, "vec_id long, embedding array<double>, leaf long"), "query-homes")
    found = _searched(parts, blocked(first), k, factor, top)
    if leaves > 1:
        found = written(found, "home-neighbours")
        place = Window.partitionBy("query_id").orderBy(F.desc("score"))
        worst = found.withColumn("r", F.row_number().over(place)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("worst"))

        def reached(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                aug = np.hstack([_matrix(batch.column(1)), np.zeros((batch.num_rows, 1))])
                worst = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
                reach = np.sqrt(np.maximum(np.einsum("ij,ij->i", aug, aug) + top - 2 * np.where(np.isnan(worst), -np.inf, worst), 0.0))
                known, gap = tree.value.gaps(aug, bounds)
                near = (gap <= factor * reach[:, None] + 1e-9) & (known[None, :] != batch.column(2).to_numpy()[:, None])
                qi, at = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(qi)), batch.column(1).take(pa.array(qi)), pa.array(known[at])], names=["vec_id", "embedding", "leaf"])

        asks = first.join(worst, "vec_id", "left").select("vec_id", "embedding", "leaf", "worst").mapInArrow(reached, "vec_id long, embedding array<double>, leaf long")
        found = found.union(_searched(parts, blocked(written(asks, "query-visits")), k, factor, top))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

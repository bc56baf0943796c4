"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is its set of distinct word shingles. Equal sets are folded first.
Each remaining set gets a MinHash signature of ``TREES * DEPTH`` values; tree t
orders the sets by its own ``DEPTH`` values, and tree ``TREES + t`` by those of
tree t with the last first, so their prefixes share no value. Lower similarities
take more trees. Neighbours with a long common
prefix are candidates: a region of equal prefixes of length ``SHALLOW`` whose
size is small gives all its pairs, a larger one is cut at ever longer prefixes.
Candidates are checked on full sets before they count as links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textvec as tv
from sparkloom.llm.common import components, marked, temporary, written

TREES, DEPTH, SHALLOW = 16, 8, 4
BINS = TREES * DEPTH
#: A region up to this size gives all its pairs; a larger one is cut at STARS.
REGION, STARS = 16, (SHALLOW, 6, DEPTH)
#: Rows of a large region outside its largest component, and of all its rows, that meet in one task.
STRAY_BLOCK, ROW_BLOCK = 256, 1024
#: Rows of one region that are cut further at once.
REGION_CHUNK = 4096
#: Chance that no tree has a pair of the least similarity with equal prefixes.
MISSED = 1e-5
#: A pair is not checked when its share of equal signature values is so many
#: standard deviations below the least similarity.
SKETCH_DEVIATIONS = 4.75

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def trees_for(percent: int) -> int:
    """Trees that keep MISSED at this similarity: 16 at 85, 22 at 80. No more than
    ``2 * TREES``, which holds down to 75; lower ones are missed more often."""
    alike = (percent / 100) ** SHALLOW
    return min(2 * TREES, math.ceil(math.log(MISSED) / math.log(1 - alike))) if alike < 1 else 1


def sketch_floor(percent: int) -> float:
    """Share of equal signature values under which a pair is not checked."""
    s = percent / 100
    return s - SKETCH_DEVIATIONS * math.sqrt(s * (1 - s) / BINS)


def _shingles(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of so many word hashes."""
    if len(h) < words:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - words + 1] * _C[0]
    for k in range(1, words):
        out = tv.mix(out + h[k : len(h) - words + 1 + k] * _C[k % 3] + np.uint64(k))
    return out


def _whole(h: np.ndarray) -> np.ndarray:
    """The hash of a text of fewer words than a shingle."""
    out = np.array([len(h)], np.uint64)
    for k in range(len(h)):
        out = tv.mix(out * _C[1] + h[k : k + 1])
    return out


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int = 3, key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, by two hashes, and where each text's begin.

    The second hashes, made with the run's ``key``, tell shingles apart and are
    sorted within a text; the first are the same in every run.
    """
    found = tv.Words(buf, offsets, tv.NOT_SPACE, key)
    begin = found.begin
    first, second = _shingles(found.hashes, words), _shingles(found.second, words)
    own, other = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for i in range(len(begin) - 1):
        a, b = begin[i], begin[i + 1]
        if b - a >= words:
            values, at = np.unique(second[a : b - words + 1], return_index=True)
            own.append(first[a + at])
            other.append(values)
        elif b > a:
            own.append(_whole(found.hashes[a:b]))
            other.append(_whole(found.second[a:b]))
        else:
            own.append(own[0]), other.append(own[0])
    sizes = np.cumsum([len(x) for x in own])
    return np.concatenate(own), np.concatenate(other), sizes.astype(np.int64)


def exact_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The set of shingles of each text as numbers, which within this column are equal if, and only if, the words are."""
    found = tv.Words(*tv.column_bytes(column), tv.NOT_SPACE)
    ids, begin, sets, short = found.ids().astype(np.int64), found.begin, [], {}
    runs = ids[: max(0, len(ids) - words + 1)]
    for k in range(1, words):
        runs = np.unique(runs * (len(ids) + 1) + ids[k : len(ids) - words + 1 + k], return_inverse=True)[1]
    for i in range(len(column)):
        a, b = begin[i], begin[i + 1]
        if b - a >= words:
            sets.append(np.unique(runs[a : b - words + 1]))
        else:
            # a text of fewer words than a shingle is one shingle, of its own kind
            sets.append(np.array([-1 - short.setdefault(tuple(ids[a:b].tolist()), len(short))] if b > a else [], np.int64))
    return sets


def signatures(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Signatures (sets x BINS, uint16) of sets of hashes, in time linear in their sizes.

    Round r deals every element to a bin by a hash of its own; a bin takes the
    least value of the first round that reaches it. From round BINS on, round
    BINS + j deals all elements to bin j, so no bin of a non-empty set stays
    empty. Two sets agree in a bin with a probability of their similarity.
    """
    n = len(begin) - 1
    least = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    filled = np.zeros(n * BINS, bool)
    doc = np.repeat(np.arange(n), np.diff(begin))
    with np.errstate(over="ignore"):
        for r in range(2 * BINS):
            if not len(values):
                break
            x = tv.mix(values + np.uint64(r + 1) * _C[2])
            part = (x & np.uint64(BINS - 1)).astype(np.int64) if r < BINS else np.full(len(x), r - BINS)
            cell = doc * BINS + part
            free = ~filled[cell]
            cell, low = cell[free], x[free] >> np.uint64(7)
            np.minimum.at(least, cell, low)
            filled[cell] = True
            open_docs = ~filled.reshape(n, BINS).all(axis=1)
            if r == 0:
                open_docs[np.diff(begin) == 0] = False
            keep = open_docs[doc]
            if not keep.all():
                values, doc = values[keep], doc[keep]
        mixed = tv.mix(least ^ np.tile(np.arange(BINS, dtype=np.uint64), n))
    return (mixed & np.uint64(0xFFFF)).astype(np.uint16).reshape(n, BINS)


SET_SCHEMA = "doc_id long, n_shingles long, d1 long, d2 long, sig binary"


def sketch_docs(docs: DataFrame, words: int, key: int) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, sig``: size, 128-bit digest and signature of each set.

    Half of the digest is of hashes made with the run's ``key``; the signature
    is not, so candidates are the same in every run.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tv.slices(batch.column(1)):
                *both, begin = shingle_sets(*tv.column_bytes(batch.column(1).slice(a, b - a)), words, key)
                sig = signatures(both[0], begin)
                digests = []
                for values, c in zip(both, _C, strict=False):
                    sums = np.zeros(len(values) + 1, np.uint64)
                    np.cumsum(tv.mix(values ^ c), out=sums[1:])
                    digests.append((sums[begin[1:]] - sums[begin[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(begin)), *map(pa.array, digests), pa.array([s.tobytes() for s in sig], pa.binary())],
                    names=["doc_id", "n_shingles", "d1", "d2", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sketch, SET_SCHEMA)


def _pairs_of(nodes: np.ndarray) -> np.ndarray:
    """All pairs a < b of distinct nodes."""
    nodes = np.unique(nodes)
    i, j = np.triu_indices(len(nodes), 1)
    return np.stack([nodes[i], nodes[j]], axis=1)


def region_pairs(node: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
    """Candidate pairs of one region: all if it is small. A larger one gives the
    neighbours in its sorted order and, at the depths in STARS, the pairs of each
    part's rows with its least node."""
    if len(node) <= REGION:
        return [_pairs_of(node)]
    order = np.argsort(rest, kind="stable")
    node, rest = node[order], rest[order]
    following = np.sort(np.stack([node[:-1], node[1:]], axis=1), axis=1)
    out = [following[following[:, 0] != following[:, 1]]]
    for depth in STARS:
        key = rest >> np.uint64(16 * (DEPTH - depth)) if depth > SHALLOW else np.zeros(len(rest), np.uint64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        least = np.repeat(np.minimum.reduceat(node, cuts), np.diff(np.append(cuts, len(node))))
        star = np.stack([least, node], axis=1)
        out.append(star[least != node])
    return out


def region_rows(batches: Iterator[pa.RecordBatch], chunk: int = REGION_CHUNK) -> Iterator[pa.RecordBatch]:
    """``a, b, region`` of :func:`candidate_pairs` from rows ``tree, prefix, rest, node`` in order.

    A region of over ``chunk`` rows that goes on in the next batch is cut; all
    its rows come out as those of a large region, however few follow.
    """
    held: list[np.ndarray] = []
    cut = False  # whether the rows held are of a region that came out in part
    for batch in batches:
        tree, prefix, rest, node = (batch.column(k).to_numpy() for k in range(4))
        now = [tree.astype(np.int64), prefix, rest.view(np.uint64), node]
        if held:
            now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(now[0]) | np.diff(now[1])) + 1, [len(now[0])]])
        last = cuts[-2]
        yield from _emit(now, cuts[:-1], cut)
        cut = cut and last == 0
        if len(now[0]) - last > chunk:
            # a very large region: this part of its sorted order is cut further, and its last row goes on as a neighbour
            yield from _emit(now, [last, len(now[0])], cut)
            held, cut = [x[-1:] for x in now], True
        else:
            held = [x[last:] for x in now]
    if held:
        yield from _emit(held, [0, len(held[0])], cut)


def _emit(cols: list[np.ndarray], cuts, first_large: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of the regions between ``cuts``, and the rows of the large ones; the first is large if so told."""
    cuts = np.asarray(cuts)
    found, large, region = [], [], []
    for k in np.flatnonzero(np.diff(cuts) > 1):
        a, b = cuts[k], cuts[k + 1]
        found += region_pairs(cols[3][a:b], cols[2][a:b])
        if b - a > REGION or (first_large and k == 0):
            large.append(cols[3][a:b])
            region.append(np.full(b - a, tv.mix(cols[1][a : a + 1].view(np.uint64) * _C[0] + cols[0][a : a + 1].astype(np.uint64)).view(np.int64)[0]))
    if found:
        pairs = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], names=["a", "b", "region"])
    if large:
        nodes = np.concatenate(large)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(nodes), pa.int64()), pa.array(np.concatenate(region))], names=["a", "b", "region"])


def candidate_pairs(sets: DataFrame, trees: int = TREES) -> DataFrame:
    """``a, b, region``: pairs a < b of ``sets(node, sig)`` that neighbour in some
    of the first ``trees`` trees, with a null region; and the rows of large regions, as ``a`` and ``region``."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, TREES, DEPTH).astype(np.uint64)
            sig = np.concatenate([sig, sig[:, :, ::-1]], axis=1)[:, :trees]
            prefix, rest = sig[:, :, 0], np.zeros(sig.shape[:2], np.uint64)
            for k in range(1, SHALLOW):
                prefix = prefix << np.uint64(16) | sig[:, :, k]
            for k in range(SHALLOW, DEPTH):
                rest = rest << np.uint64(16) | sig[:, :, k]
            tree = np.tile(np.arange(trees, dtype=np.int32), len(sig))
            node = np.repeat(batch.column(0).to_numpy(), trees)
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(prefix.ravel().view(np.int64)), pa.array(rest.ravel().view(np.int64)), pa.array(node)], names=["tree", "prefix", "rest", "node"])

    rows = sets.select("node", "sig").mapInArrow(explode, "tree int, prefix long, rest long, node long")
    ordered = rows.repartition("tree", "prefix").sortWithinPartitions("tree", "prefix", "rest", "node")
    return ordered.mapInArrow(region_rows, "a long, b long, region long")


def stray_links(hot: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, words: int, key: int) -> DataFrame:
    """Links in large regions that a look at neighbours alone has missed.

    ``hot(region, node)`` holds the large regions and ``labels(node, component)``
    what is linked so far. A region of one component needs nothing more. The
    others are united by their largest component; there each row of another
    component meets all rows, in blocks of bounded size. Pairs with similar
    signatures are checked on full sets, the most similar first, and a link
    comes out only where it joins components not yet joined in that task.
    """
    named = hot.distinct().join(labels, "node", "left").select("region", "node", F.coalesce("component", "node").alias("label"))
    main = named.groupBy("region", "label").agg(F.count("*").alias("n")).groupBy("region").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")
    ).where("labels > 1")
    rows = written(named.join(main, "region").select("main", "node", "label").distinct(), "strays")
    sizes = rows.groupBy("main").agg(
        F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("row_blocks"), F.ceil(F.count_if(F.col("label") != F.col("main")) / STRAY_BLOCK).cast("int").alias("stray_blocks")
    )
    some = marked(texts, "node", rows.select("node")).where("may").drop("may")
    rows = written(rows.join(sizes, "main").join(classes.select("node", "sig", "n"), "node").join(some, "node"), "stray-texts")
    h = F.xxhash64("node", F.lit(3))
    held = ["node", "label", "n", "sig", "text"]
    strays = rows.where("label <> main").select(
        "main", F.pmod(h, "stray_blocks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("j"), F.lit(True).alias("stray"), *held
    )
    others = rows.select(
        "main", F.explode(F.sequence(F.lit(0), F.col("stray_blocks") - 1)).alias("i"), F.pmod(h, "row_blocks").cast("int").alias("j"), F.lit(False).alias("stray"), *held
    )

    def compare(table: pa.Table) -> pa.Table:
        stray = table["stray"].to_numpy()
        node, label, n = (table[c].to_numpy() for c in ("node", "label", "n"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, BINS)
        column, sets, root = table["text"].combine_chunks(), {}, {}
        rest = np.flatnonzero(~stray)

        def full(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_sets(*tv.column_bytes(column.slice(i, 1)), words, key)[1]
            return sets[i]

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        a, b = [], []
        for x in np.flatnonzero(stray):
            alike = (sig[rest] == sig[x]).mean(axis=1)
            fits = (alike >= sketch_floor(percent)) & (label[rest] != label[x]) & (100 * np.minimum(n[rest], n[x]) >= percent * np.maximum(n[rest], n[x]))
            close = rest[fits][np.argsort(-alike[fits], kind="stable")]
            for y in close:
                p, q = top(int(label[x])), top(int(label[y]))
                if p != q:
                    both = len(np.intersect1d(full(int(x)), full(int(y)), assume_unique=True))
                    if 100 * both >= percent * (n[x] + n[y] - both):
                        root[max(p, q)] = min(p, q)
                        a.append(node[x]), b.append(node[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return strays.union(others).groupBy("main", "i", "j").applyInArrow(compare, "a long, b long")


def _similar(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b, sig_a, sig_b)`` whose signatures agree in at least that share."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BINS) for k in (2, 3))
                mask = pa.array((x == y).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(mask)

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(keep, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Pairs whose full sets have ``100 * intersection >= percent * union``, words compared by their bytes.

    ``texts(node, text)`` holds the texts of all nodes; only those in a pair move.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in tv.slices(batch.column(2)):
                part = batch.slice(at, end - at)
                sets = exact_sets(pa.concat_arrays([part.column(2).cast(pa.large_string()), part.column(3).cast(pa.large_string())]), words)
                ok = []
                for s, t in zip(sets, sets[part.num_rows :], strict=False):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    ok.append(100 * both >= percent * (len(s) + len(t) - both) and both > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    needed = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")
    some = written(marked(texts, "node", needed).where("may").drop("may").join(needed, "node", "left_semi"), "texts")
    left, right = some.toDF("a", "text_a"), some.toDF("b", "text_b")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 3) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs(doc_id, text, ...)``.

    Words are runs of non-space characters, A-Z lower-cased. Documents are
    linked when ``100 * intersection >= percent * union`` of their shingle sets;
    a text of fewer words than a shingle is one shingle. ``component_id`` is the
    smallest doc_id reachable. Texts without words, and null texts, are linked
    with nothing. Rows with a null doc_id take no part and come out with a null
    component and kept. Repeated rows give a row each. An empty table stays
    empty; a very long text is read whole, in blocks; other columns are not
    read, so their names don't matter. Two texts of one digest of 128 bits, of
    which half is keyed anew in each run, count as the same set; links between
    different sets are confirmed on the words themselves.
    """
    with temporary() as keep:
        return keep(_near_duplicates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), percent, words))


def _near_duplicates(texts: DataFrame, percent: int, words: int) -> DataFrame:
    key = tv.new_key()
    sets = written(sketch_docs(texts, words, key), "sets")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    classes = written(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
    x, y = classes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a")), classes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    fits = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    named_texts = texts.where("doc_id is not null").toDF("node", "text")
    found = written(candidate_pairs(classes, trees_for(percent)), "found")
    near = found.where("region is null").select("a", "b").distinct().join(x, "a").join(y, "b").where(fits)
    near = written(_similar(near, sketch_floor(percent)), "near")
    grouped = components(confirm(near, named_texts, percent, words), "links")
    hot = found.where("region is not null").select("region", F.col("a").alias("node"))
    if not hot.isEmpty():
        # strays are compared by keyed hashes, and what joins components is confirmed like other pairs
        links = confirm(written(stray_links(hot, grouped, classes, named_texts, percent, words, key), "stray-links"), named_texts, percent, words)
        grouped = components(links.union(grouped.toDF("a", "b")), "more-links")
    grouped = grouped.withColumnRenamed("component", "least")
    named = classes.select("d1", "d2", "node").join(grouped, "node", "left").select("d1", "d2", F.coalesce("least", "node").alias("least"))
    rows = sets.select("doc_id", "n_shingles", F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.col("d1")).alias("d1"), "d2")
    return rows.join(named, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("least", "doc_id"), F.lit(True)).alias("kept"),
    )

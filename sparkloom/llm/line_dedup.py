"""Near-duplicate lines by a segment-partition edit join.

Two lines within ``tau`` edits share, when one is cut into ``tau + 1`` segments,
at least one segment unchanged (Li et al., 2011). Each distinct line is indexed
by its segments and probes, for each length it can match, the few substrings
that can hold a segment; equal keys are candidates, and a banded bit-parallel
edit distance decides. Lines that reach one another form a class, of which the
first occurrence stays.

A key that few lines share gives their pairs. One that many share gives a star,
a pair of each line with the key's least; when that leaves the lines in several
classes they are cut finer, into ``tau + 2`` segments of which two must be
equal, and what many lines then still share is compared in blocks, the lines
outside the key's largest class with all others. So no key gives all its pairs,
and none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textvec as tv
from sparkloom.llm.common import components, forget, marked, temporary, written

#: Edits, and the least length in bytes of a line that is matched by edits; shorter ones match when equal.
TAU, MIN_BYTES = 2, 20
#: A key gives the pairs of up to FEW lines. Lines that meet in one task at most: strays and others.
FEW, STRAY_BLOCK, ROW_BLOCK = 8, 256, 1024
#: Byte kinds that are counted to rule out pairs.
KINDS = 32

_IN_LINE = np.ones(256, bool)
_IN_LINE[10] = False
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def within(a: bytes, b: bytes, k: int) -> bool:
    """Whether the edit distance of ``a`` and ``b`` is at most ``k``.

    Equal ends are cut off. Bit i of ``level[e]`` says that ``i`` bytes of ``a``
    match the bytes of ``b`` read so far with at most e edits; only the band of
    ``2 k + 1`` diagonals that can still end well is kept.
    """
    if abs(len(a) - len(b)) > k:
        return False
    short = min(len(a), len(b))
    start = _common(a, b, short)
    a, b, short = a[start:], b[start:], short - start
    end = _common(a[::-1], b[::-1], short)
    if end:
        a, b = a[:-end], b[:-end]
    m, n = len(a), len(b)
    if not m or not n:
        return max(m, n) <= k
    places: dict[int, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 2 << i
    level = [(1 << (e + 1)) - 1 for e in range(k + 1)]
    band = (1 << (2 * k + 1)) - 1
    for j, c in enumerate(b, 1):
        here = places.get(c, 0)
        inside = band << (j - k) if j >= k else band >> (k - j)
        before = level[0]
        level[0] = before << 1 & here & inside
        for e in range(1, k + 1):
            now = level[e]
            level[e] = (now << 1 & here | before | before << 1 | level[e - 1] << 1) & inside
            before = now
        if not level[k]:
            return False
    return bool(level[k] >> m & 1)


def _common(a: bytes, b: bytes, n: int) -> int:
    """Length of the common prefix, at most n."""
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Lines:
    """The lines of some texts: non-empty runs between newlines, A-Z lower-cased,
    trimmed of ASCII white space, of at least ``least`` bytes; with the texts'
    numbers and each line's number among its text's non-empty lines."""

    def __init__(self, column: pa.Array, least: int):
        buf, offsets = tv.column_bytes(column)
        self.parts = []
        counted = np.zeros(len(offsets), np.int64)
        for _, doc, start, end, part in tv.words(buf, offsets, _IN_LINE):
            number = np.arange(len(doc)) - np.searchsorted(doc, doc) + counted[doc]
            counted += np.bincount(doc, minlength=len(counted))
            solid = np.append(np.flatnonzero(tv.NOT_SPACE[part]), len(part))
            first = np.searchsorted(solid, start)
            last = np.searchsorted(solid, end) - 1
            full = (last >= first) & (first < len(solid) - 1)
            first, last = solid[np.minimum(first, len(solid) - 1)], solid[np.maximum(last, 0)] + 1
            full &= last - first >= least
            self.parts.append((doc[full], number[full], first[full], last[full], part))

    def digests(self, seal: Seal) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``doc, number, d1, d2`` of the lines."""
        for doc, number, a, b, part in self.parts:
            yield doc, number, *seal(part, a, b)


@dataclass(frozen=True)
class Seal:
    """Digests of lines, with a key for the run: two halves of 64 bits. ``bits`` of the first are kept, fewer than 64 only to try what equal ones do."""

    key: int
    bits: int = 64

    def __call__(self, part: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d1, d2 = tv.byte_digest(part, a, b, self.key)
        return d1 & np.uint64((1 << self.bits) - 1), d2


def line_table(docs: DataFrame, seal: Seal) -> DataFrame:
    """``doc_id, line, d1, d2``: an occurrence of a line, and its 128-bit digest."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tv.slices(batch.column(1)):
                ids = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)
                for doc, number, d1, d2 in Lines(batch.column(1).slice(a, b - a), 1).digests(seal):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(number.astype(np.int32)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], names=["doc_id", "line", "d1", "d2"])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, line int, d1 long, d2 long")


def _moves(chosen: tuple[int, ...], gap: int, tau: int, segments: int) -> list[tuple[int, ...]]:
    """How far the chosen segments can lie from their places in a line that is
    ``gap`` longer: between them, and to the ends, each step costs an edit."""
    if segments == tau + 1:
        # with one segment more than edits, those before and after it have one each at most
        i = chosen[0]
        return [(m,) for m in range(max(-i, gap - (tau - i)), min(i, gap + (tau - i)) + 1)]
    found: list[tuple[tuple[int, ...], int]] = [((), 0)]
    for _ in chosen:
        found = [((*f, m), cost + abs(m - (f[-1] if f else 0))) for f, cost in found for m in range(-tau, tau + 1) if cost + abs(m - (f[-1] if f else 0)) <= tau]
    return [f for f, cost in found if cost + abs(gap - f[-1]) <= tau]


KEY_SCHEMA = "key long, node long, probe boolean"


def line_keys(part: np.ndarray, node: np.ndarray, a: np.ndarray, size: np.ndarray, tau: int, segments: int, least: int) -> pa.RecordBatch:
    """``key, node, probe`` of lines: each choice of ``segments - tau`` of their
    segments and, with probe, of the substrings where a longer line can hold them."""
    sums, inverse = tv.prefix_sums(part)
    keys, nodes, probes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for gap in range(tau + 1):
        length = size - gap
        step, longer = length // segments, segments - length % segments
        begin = [i * step + np.maximum(i - longer, 0) for i in range(segments)]
        width = [step + (i >= longer) for i in range(segments)]
        for number, chosen in enumerate(combinations(range(segments), segments - tau)):
            for moves in _moves(chosen, gap, tau, segments):
                fits = length >= least
                for i, move in zip(chosen, moves, strict=True):
                    fits = fits & (begin[i] + move >= 0) & (begin[i] + move + width[i] <= size)
                ok = np.flatnonzero(fits)
                key = length[ok].astype(np.uint64) * _C[1] + np.uint64(number)
                for i, move in zip(chosen, moves, strict=True):
                    at = (a + begin[i])[ok] + move
                    key = tv.mix(key + tv.range_hash(sums, inverse, at, at + width[i][ok]) * _C[0])
                keys.append(key), nodes.append(node[ok]), probes.append(np.full(len(ok), bool(gap or any(moves))))
    key, own, probe = (np.concatenate(c) for c in (keys, nodes, probes))
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own.view(np.int64)), pa.array(probe)], names=["key", "node", "probe"])


def segment_keys(docs: DataFrame, tau: int, least: int, seal: Seal) -> DataFrame:
    """``key, node, probe`` of each line, cut into ``tau + 1`` segments; ``node`` is the line's d1."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in tv.slices(batch.column(0)):
                for _, _, a, b, part in Lines(batch.column(0).slice(x, y - x), least).parts:
                    d1, d2 = seal(part, a, b)
                    # equal lines once; sorted by d1, those of the first place of each pair of halves
                    order = np.lexsort((d2, d1))
                    new = np.ones(len(order), bool)
                    new[1:] = (d1[order[1:]] != d1[order[:-1]]) | (d2[order[1:]] != d2[order[:-1]])
                    once = order[new]
                    yield line_keys(part, d1[once], a[once], (b - a)[once], tau, tau + 1, least)

    return docs.select("text").mapInArrow(keys, KEY_SCHEMA)


def finer_keys(texts: DataFrame, tau: int, least: int) -> DataFrame:
    """``key, node, probe`` of lines ``(node, line)``, cut into ``tau + 2`` segments."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in tv.slices(batch.column(1), 1 << 18):
                column = batch.column(1).slice(x, y - x).cast(pa.large_binary())
                offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                part = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                node = batch.column(0).slice(x, y - x).to_numpy().view(np.uint64)
                yield line_keys(part, node, offsets[:-1] - offsets[0], np.diff(offsets), tau, tau + 2, least)

    return texts.select("node", "line").mapInArrow(keys, KEY_SCHEMA)


def candidates(keys: DataFrame, few: int, label: str) -> DataFrame:
    """``a, b, key``: pairs of lines that share a key, with a null key; and the
    lines of keys that more than ``few`` share, as ``a``, with ``b`` 1 for a probe."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)], None
        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)]
            now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            yield from _of_keys([x[:last] for x in now], few, many)
            if last and many != now[0][-1]:
                many = None
            held = [x[last:] for x in now]
            if len(held[0]) > 1 << 16:
                # a key too large to wait for: its rows go on as they come
                many = held[0][0]
                yield from _of_keys(held, few, many)
                held = [x[:0] for x in held]
        yield from _of_keys(held, few, many)

    return written(keys.repartition("key").sortWithinPartitions("key").mapInArrow(shared, "a long, b long, key long"), label)


def _of_keys(rows: list[np.ndarray], few: int, many: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs or lines of whole keys; ``many`` names one of which a part came before."""
    # each line once in a key, as no probe if it is both
    order = np.lexsort((rows[2], rows[1], rows[0]))
    key, node, probe = (x[order] for x in rows)
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, probe = key[first], node[first], probe[first]
    if not len(key):
        return
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    sizes = np.diff(np.append(cuts, len(key)))
    named = key[cuts] == many if many is not None else np.zeros(len(cuts), bool)
    open_ = (sizes > 1) & ~np.logical_and.reduceat(probe, cuts) | named
    small = open_ & (sizes <= few) & ~named
    pairs = []
    for n in np.unique(sizes[small]):
        at = cuts[small & (sizes == n)]
        for i, j in combinations(range(n), 2):
            x, y = at + i, at + j
            good = ~(probe[x] & probe[y])
            pairs.append(np.stack([np.minimum(node[x], node[y])[good], np.maximum(node[x], node[y])[good]]))
    if pairs:
        pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.nulls(pairs.shape[1], pa.int64())], names=["a", "b", "key"])
    large = np.repeat(open_ & ~small, sizes)
    yield pa.RecordBatch.from_arrays([pa.array(node[large]), pa.array(probe[large].astype(np.int64)), pa.array(key[large])], names=["a", "b", "key"])


def _line_texts(docs: DataFrame, lines: DataFrame, nodes: DataFrame, seal: Seal) -> DataFrame:
    """``node, d2, line`` (bytes) of all lines with these first halves, each read at its first occurrence."""
    first = lines.groupBy(F.col("d1").alias("node"), "d2").agg(F.min(F.struct("doc_id", "line")).alias("at"))
    places = nodes.join(first, "node").select("at.doc_id", "at.line")
    by_doc = written(places.groupBy("doc_id").agg(F.collect_set("line").alias("wanted")), "places")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in tv.slices(batch.column(0)):
                wanted = [set(w) for w in batch.column(1).slice(x, y - x).to_pylist()]
                found = Lines(batch.column(0).slice(x, y - x), 1)
                for (doc, number, d1, d2), (*_, a, b, part) in zip(found.digests(seal), found.parts, strict=True):
                    keep = [i for i in range(len(doc)) if number[i] in wanted[doc[i]]]
                    raw = [part[a[i] : b[i]].tobytes() for i in keep]
                    yield pa.RecordBatch.from_arrays([pa.array(d1[keep].view(np.int64)), pa.array(d2[keep].view(np.int64)), pa.array(raw, pa.binary())], names=["node", "d2", "line"])

    some = marked(docs.select("doc_id", "text"), "doc_id", by_doc.select("doc_id")).where("may")
    texts = written(some.join(by_doc, "doc_id").select("text", "wanted").mapInArrow(read, "node long, d2 long, line binary").distinct(), "line-texts")
    forget(by_doc)
    return texts


def _twins(texts: DataFrame) -> DataFrame:
    """``node, d2, id``: lines whose first half another line has as well, but for one of each such; ``id`` is a node of their own."""
    shared = texts.groupBy("node").agg(F.min("d2").alias("first"), F.count("*").alias("n")).where("n > 1")
    return written(texts.select("node", "d2").join(shared, "node").where("d2 <> first").select("node", "d2", F.xxhash64("node", "d2").alias("id")), "line-twins")


def _told_apart(found: DataFrame, twins: DataFrame) -> DataFrame:
    """The rows of :func:`candidates` for each of the lines that a node stands for, and those lines as pairs."""
    own = twins.select(F.col("node").alias("of"), "id")

    def each(df: DataFrame, c: str) -> DataFrame:
        return df.union(df.join(own, F.col(c) == F.col("of")).select(*[F.col("id").alias(x) if x == c else F.col(x) for x in df.columns]))

    ids = own.union(own.select("of", F.col("of").alias("id")).distinct())
    among = ids.join(ids.withColumnRenamed("id", "other"), "of").where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"), F.lit(None).cast("long").alias("key"))
    pairs = each(each(found.where("key is null"), "a"), "b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "key")
    return written(pairs.union(each(found.where("key is not null"), "a")).union(among), "line-told-apart")


def _checked(found: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    """Links ``a, b`` among the pairs of :func:`candidates` and the stars of its large keys."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within(x.as_py(), y.as_py(), tau) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    large = found.where("key is not null")
    least = large.where("b = 0").groupBy("key").agg(F.min("a").alias("least"))
    stars = large.join(least, "key").where("a <> least").select(F.least("a", "least"), F.greatest("a", "least"))
    pairs = found.where("key is null").select("a", "b").union(stars).distinct()
    both = pairs.join(texts.toDF("a", "line_a"), "a").join(texts.toDF("b", "line_b"), "b")
    return both.select("a", "b", "line_a", "line_b").mapInArrow(check, "a long, b long")


def _unsettled(found: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """``key, node, probe, class, main`` of large keys whose lines are in several classes; main is the largest."""
    named = found.where("key is not null").select("key", F.col("a").alias("node"), F.col("b").alias("probe")).join(classes, "node", "left")
    named = named.select("key", "node", "probe", F.coalesce("component", "node").alias("class"))
    sizes = named.groupBy("key", "class").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.count("*").alias("classes")).where("classes > 1")
    return written(named.join(main.drop("classes"), "key"), label)


def _block_links(rows: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    """Links in keys that hold many lines: those outside the key's largest class
    meet all its lines, in blocks of bounded size. Byte counts rule most pairs
    out, and only links that join classes not yet joined in a task come out."""
    sizes = rows.groupBy("key").agg(
        F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("row_blocks"), F.ceil(F.count_if(F.col("class") != F.col("main")) / STRAY_BLOCK).cast("int").alias("stray_blocks"),
    )
    h, held = F.xxhash64("node", F.lit(5)), ["node", "probe", "class", "line"]
    dealt = rows.join(sizes, "key").join(texts, "node")
    strays = dealt.where("class <> main").select(
        "key", F.pmod(h, "stray_blocks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("j"), F.lit(True).alias("stray"), *held,
    )
    others = dealt.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("stray_blocks") - 1)).alias("i"), F.pmod(h, "row_blocks").cast("int").alias("j"), F.lit(False).alias("stray"), *held,
    )

    def compare(table: pa.Table) -> pa.Table:
        stray, node, probe, label = (table[c].to_numpy() for c in ("stray", "node", "probe", "class"))
        lines, root = table["line"].to_pylist(), {}
        size = np.array([len(x) for x in lines])
        kinds = np.stack([np.bincount(np.frombuffer(x, np.uint8) % KINDS, minlength=KINDS) for x in lines]).astype(np.int32)
        rest = np.flatnonzero(~stray)

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        a, b = [], []
        for x in np.flatnonzero(stray):
            near = (np.abs(size[rest] - size[x]) <= tau) & (label[rest] != label[x]) & (probe[rest] + probe[x] < 2)
            near = rest[near]
            # an edit changes the counts of two kinds by one at most
            for y in near[np.abs(kinds[near] - kinds[x]).sum(axis=1) <= 2 * tau]:
                p, q = top(int(label[x])), top(int(label[y]))
                if p != q and within(lines[x], lines[y], tau):
                    root[max(p, q)] = min(p, q)
                    a.append(node[x]), b.append(node[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return strays.union(others).groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def line_classes(docs: DataFrame, lines: DataFrame, tau: int, least: int, few: int, seal: Seal) -> tuple[DataFrame, DataFrame | None]:
    """``node, component`` of the lines that are linked with another; see the module's docstring. And the :func:`_twins`, if there are any."""
    found = candidates(segment_keys(docs, tau, least, seal), few, "line-candidates")
    texts = _line_texts(docs, lines, found.select(F.explode(F.when(F.col("key").isNull(), F.array("a", "b")).otherwise(F.array("a"))).alias("node")).distinct(), seal)
    twins = _twins(texts)
    if twins.isEmpty():
        twins, texts = None, texts.select("node", "line")
    else:
        found = _told_apart(found, twins)
        texts = texts.join(twins, ["node", "d2"], "left").select(F.coalesce("id", "node").alias("node"), "line")
    classes = components(_checked(found, texts, tau), "line-links")
    open_ = _unsettled(found, classes, "line-unsettled")
    forget(found)
    if not open_.isEmpty():
        some = texts.join(open_.select("node").distinct(), "node", "left_semi")
        finer = candidates(finer_keys(some, tau, least), few, "line-finer")
        classes = components(_checked(finer, texts, tau).union(classes.toDF("a", "b")), "line-finer-links")
        still = _unsettled(finer, classes, "line-still-unsettled")
        forget(finer)
        if not still.isEmpty():
            classes = components(_block_links(still, texts, tau).union(classes.toDF("a", "b")), "line-block-links")
        forget(still)
    forget(open_)
    return classes, twins


def duplicate_lines(docs: DataFrame, tau: int = TAU, least: int = MIN_BYTES, few: int = FEW) -> DataFrame:
    """``doc_id, line``: the lines that are not the first occurrence of their class.

    Lines are compared as UTF-8 bytes, A-Z lower-cased and trimmed, by edits
    from ``least`` bytes on; shorter ones are of one class when equal. ``line``
    counts a text's non-empty lines from 0; lines of white space only are none.
    Occurrences are ordered by doc_id and line. Rows with a null doc_id or text
    have no lines; rows that repeat a doc_id are one document; an empty table
    gives an empty result. A very long text is read in blocks, a very long line
    whole. Other columns are not read, so their names don't matter.

    Lines that are linked by edits were compared byte by byte; lines of one
    digest of 128 bits, keyed anew in each run, count as equal. Lines that share
    its first half only are told apart by the other.
    """
    with temporary() as keep:
        return keep(_duplicate_lines(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tau, least, few, Seal(tv.new_key())))


def _duplicate_lines(docs: DataFrame, tau: int, least: int, few: int, seal: Seal) -> DataFrame:
    lines = written(line_table(docs, seal), "lines")
    classes, twins = line_classes(docs, lines, tau, least, few, seal)
    nodes = lines.withColumn("of", F.col("d1"))
    if twins is not None:
        nodes = lines.join(twins.withColumnRenamed("node", "d1"), ["d1", "d2"], "left").select(*lines.columns, F.coalesce("id", "d1").alias("of"))
    named = nodes.join(classes, F.col("of") == F.col("node"), "left")
    linked = F.col("component").isNotNull()
    named = named.select("doc_id", "line", linked.alias("linked"), F.coalesce("component", "d1").alias("class"), F.when(linked, 0).otherwise(F.col("d2")).alias("rest"))
    first = named.groupBy("linked", "class", "rest").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return named.join(first, ["linked", "class", "rest"]).where(F.struct("doc_id", "line") != F.col("first")).select("doc_id", "line")


def dedup_lines(docs: DataFrame, tau: int = TAU, least: int = MIN_BYTES) -> DataFrame:
    """``docs`` without the lines that :func:`duplicate_lines` names.

    A document of which nothing but white space is left goes, unless it had
    nothing else before. Rows without such lines, with a null doc_id or a null
    text come back as they were; repeated rows come back once each, cut alike.
    All columns are kept, whatever their names; an empty table stays empty.
    """
    given = docs.columns
    at = given.index("text")
    # other names, so that none clashes with the columns added
    names = [c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(given)]
    plain = docs.toDF(*names)
    with temporary() as keep:
        gone = duplicate_lines(plain, tau, least).groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_set("line").alias("gone_lines"))
        gone = keep(written(gone, "gone-lines"))
    asked = marked(plain, "doc_id", gone.select("gone_id"))
    joined = asked.where("may").join(gone, F.col("doc_id") == F.col("gone_id"), "left").select(*names, "gone_lines")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tv.slices(batch.column(at)):
                part = batch.slice(a, b - a)
                texts, keep = part.column(at).to_pylist(), []
                for i, lines in enumerate(part.column(len(names)).to_pylist()):
                    if lines:
                        texts[i] = without_lines(texts[i], set(lines))
                    keep.append(not lines or bool(texts[i].strip()))
                columns = list(part.columns[: len(names)])
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return asked.where("not may").select(*names).union(joined.mapInArrow(cut, plain.schema)).toDF(*given)


def without_lines(text: str, gone: set[int]) -> str:
    kept, k = [], 0
    for line in text.split("\n"):
        if not line or k not in gone:
            kept.append(line)
        k += bool(line)
    return "\n".join(kept)

"""Conflict-constrained best-fit packing of documents into token bins.

Documents are dealt to shards of bounded size by a hash of their id, and each
shard packs on its own: longest remainder first, into the fullest bin that
still fits and holds neither a piece of the same source nor of the same
duplicate cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import written

CAPACITY, SHARD_ROWS = 2048, 8192
_STEP = 64


class Bins:
    """Open bins in the order of their residuals, with bitmaps of what each holds."""

    def __init__(self, capacity: int, n_sources: int, n_clusters: int):
        self.capacity, self.count = capacity, 0
        self.widths = (n_sources + 63) // 64, (n_clusters + 63) // 64
        self.maps = [np.zeros((256, max(1, w)), np.uint64) for w in self.widths]
        self.order = np.zeros(0, np.int64)  # residual << 32 | bin
        self.used: list[int] = []

    def _holds(self, bins: np.ndarray, kind: int, number: int) -> np.ndarray:
        return (self.maps[kind][bins, number >> 6] >> np.uint64(number & 63)) & np.uint64(1) != 0

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The tightest bin that fits and has no conflict, or a new one; and where the piece starts in it.

        From the first bin whose residual fits, its successors are searched
        until one is compatible. A number of -1 conflicts with nothing.
        """
        at, chosen = int(np.searchsorted(self.order, size << 32)), -1
        while at < len(self.order) and chosen < 0:
            bins = self.order[at : at + _STEP] & 0xFFFFFFFF
            bad = np.zeros(len(bins), bool)
            for kind, number in ((0, source), (1, cluster)):
                if number >= 0:
                    bad |= self._holds(bins, kind, number)
            free = np.flatnonzero(~bad)
            if len(free):
                at += int(free[0])
                chosen = int(self.order[at] & 0xFFFFFFFF)
                self.order = np.delete(self.order, at)
            else:
                at += len(bins)
        if chosen < 0:
            chosen = self.count
            self.count += 1
            self.used.append(0)
            if self.count > len(self.maps[0]):
                self.maps = [np.concatenate([m, np.zeros_like(m)]) for m in self.maps]
        for kind, number in ((0, source), (1, cluster)):
            if number >= 0:
                self.maps[kind][chosen, number >> 6] |= np.uint64(1) << np.uint64(number & 63)
        start = self.used[chosen]
        self.used[chosen] += size
        if left := self.capacity - self.used[chosen]:
            key = left << 32 | chosen
            self.order = np.insert(self.order, np.searchsorted(self.order, key), key)
        return chosen, start


def pack_shard(doc: list, size: list[int], source: list, cluster: list, capacity: int) -> list[tuple]:
    """``(bin, doc, piece, start in the bin, size)``; whole bins of long documents come first."""
    out, parts, full = [], [], 0
    for i in sorted(range(len(doc)), key=lambda i: (-(size[i] % capacity), doc[i] is not None, doc[i], cluster[i] or 0, str(source[i]))):
        for piece in range(size[i] // capacity):
            out.append((full, doc[i], piece, 0, capacity))
            full += 1
        if size[i] % capacity:
            parts.append(i)
    sources = {s: k for k, s in enumerate(dict.fromkeys(source[i] for i in parts if source[i] is not None))}
    times: dict = {}
    for i in parts:
        times[cluster[i]] = times.get(cluster[i], 0) + 1
    clusters = {c: k for k, c in enumerate(c for c, n in times.items() if n > 1 and c is not None)}
    bins = Bins(capacity, len(sources), len(clusters))
    for i in parts:
        at, start = bins.place(size[i] % capacity, sources.get(source[i], -1), clusters.get(cluster[i], -1))
        out.append((full + at, doc[i], size[i] // capacity, start, size[i] % capacity))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``bin_id, doc_id, piece, start, n_tokens`` for ``docs(doc_id, source, n_tokens, cluster)``.

    A document longer than ``capacity`` is cut into whole bins and a remainder;
    nothing is dropped. Documents without tokens (null counts too) come out once
    with a null bin. Null sources and clusters conflict with nothing. Repeated
    rows are packed one by one; ties are broken by doc_id. An empty table gives
    an empty result; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"), F.col("cluster").cast("long").alias("cluster"))
    # read three times below: written, so that the tokens are counted once
    rows = written(rows, "packable")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)))

    def work(key: tuple, table: pa.Table) -> pa.Table:
        columns = [table[c].to_pylist() for c in ("doc_id", "n_tokens", "source", "cluster")]
        found = pack_shard(*columns, capacity)
        bins, *rest = zip(*found, strict=True) if found else ((),) * 5
        ids = [key[0].as_py() << 32 | b for b in bins]
        arrays = [pa.array(x, t) for x, t in zip((ids, *rest), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        return pa.table(dict(zip(("bin_id", "doc_id", "piece", "start", "n_tokens"), arrays, strict=True)))

    packed = dealt.where("n_tokens > 0").groupBy("shard").applyInArrow(work, "bin_id long, doc_id long, piece long, start long, n_tokens long")
    none = dealt.where("n_tokens <= 0").select(F.lit(None).cast("long").alias("bin_id"), "doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    return packed.union(none)


def packable(docs: DataFrame, count: Callable[[], Callable[[str], int]] | None = None) -> DataFrame:
    """What :func:`pack` needs of ``docs(doc_id, text, source, ...)``: tokens, and
    a digest of the text without case and white space as its cluster.

    ``count`` makes a tokenizer's counter in each Python worker; without one,
    words are the tokens, and a very long text without white space is one. Null
    texts are empty, with no tokens. Near copies that differ in more than case
    and white space are clusters of their own. Rows come out one for one; other
    columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cluster = F.xxhash64(F.regexp_replace(F.lower(text), r"[ \t-\r]+", ""))
    if count is None:
        words = F.size(F.array_remove(F.split(text, r"[ \t-\r]+"), "")).cast("long")
        return docs.select("doc_id", "source", words.alias("n_tokens"), cluster.alias("cluster"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = count()
        for batch in batches:
            n = pa.array([counter(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, batch.column(3)], names=["doc_id", "source", "n_tokens", "cluster"])

    rows = docs.select("doc_id", "source", text.alias("text"), cluster.alias("cluster"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(tokens, f"doc_id {kinds['doc_id']}, source {kinds['source']}, n_tokens long, cluster long")

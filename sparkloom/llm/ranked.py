"""Ranked lexical search by branch and bound over hierarchical max trees.

Documents lie in shards of bounded size. For each term of the queries a shard
holds a tree over its range of documents: a leaf is a document with its exact
impact, a node above it covers FAN ranges and holds the largest impact in
them. A query's search keeps the nodes whose ranges may still hold a winner in
a queue by their bound, the sum of its terms' maxima, opens the highest first,
and ends when no bound reaches the score of the last winner; nodes of an equal
bound are opened, since they may hold a tie of a smaller id. A shard's tasks
need nothing from others but the collection's counts; each gives its best, and
the best of those are the result.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm import textvec as tv
from sparkloom.llm.common import temporary, written

#: Children of a node.
FAN = 16
#: Documents and postings of a shard; a document of more postings is one alone.
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 19
#: Bytes of the queries that are answered in one pass, which sends their terms to the tasks; more take further passes.
PASS_BYTES = 8 << 20

INDEX_SCHEMA = "n_docs long, n_terms long, shard binary, terms array<int>, df array<int>"


def index(docs: DataFrame, terms: list[bytes], shard_docs: int, shard_postings: int) -> DataFrame:
    """A row for each shard of ``docs(doc_id, text)``: documents and words, and the postings of ``terms``."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tv.Terms(sent.value)
        held, n_held, postings = [], 0, 0

        def shard() -> pa.RecordBatch:
            ids, sizes, owner, term, tf = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((owner, term))
            owner, term, tf = owner[order], term[order], tf[order]
            seen, df = np.unique(term, return_counts=True)
            packed = pickle.dumps((ids, sizes, owner.astype(np.int32), term.astype(np.int32), tf))
            return pa.RecordBatch.from_arrays(
                [pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]), pa.array([packed], pa.binary()), pa.array([seen], pa.list_(pa.int32())), pa.array([df], pa.list_(pa.int32()))],
                names=["n_docs", "n_terms", "shard", "terms", "df"],
            )

        for batch in batches:
            for a, b in tv.slices(batch.column(1)):
                ids = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.zeros(len(ids), np.int64)
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for h, doc, start, end, part in tv.words(*tv.column_bytes(batch.column(1).slice(a, b - a)), tv.ALNUM):
                    sizes += np.bincount(doc, minlength=len(ids))
                    term = known.find(h, tv.eights(part), start, end)
                    there = term >= 0
                    key, n = np.unique(doc[there] * len(sent.value) + term[there], return_counts=True)
                    keys, counts = np.concatenate([keys, key]), np.concatenate([counts, n])
                keys, back = np.unique(keys, return_inverse=True)
                tf = np.bincount(back, weights=counts, minlength=len(keys)).astype(np.int64)
                owner, term = np.divmod(keys, max(1, len(sent.value)))
                if n_held and (n_held + len(ids) > shard_docs or postings + len(keys) > shard_postings):
                    yield shard()
                    held, n_held, postings = [], 0, 0
                held.append((ids, sizes, owner + n_held, term, tf))
                n_held, postings = n_held + len(ids), postings + len(keys)
        if held:
            yield shard()

    return docs.mapInArrow(build, INDEX_SCHEMA)


class Shard:
    """The max trees of a shard's postings."""

    def __init__(self, packed: bytes, docs: int, words: int):
        self.ids, sizes, owner, term, tf = pickle.loads(packed)
        # 64-bit whole numbers, rounded down
        norm = 50 + 50 * sizes * docs // max(words, 1)
        self.at, self.most, self.child = [owner.astype(np.int64)], [1_000_000_000 * tf // (1000 * tf + 20 * norm[owner])], [np.zeros(0, np.int64)]
        term = term.astype(np.int64)
        while len(term) and self.at[-1].max() > 0:
            above = self.at[-1] // FAN
            first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (above[1:] != above[:-1])]))
            self.at.append(above[first])
            self.most.append(np.maximum.reduceat(self.most[-1], first))
            self.child.append(np.append(first, len(term)))
            term = term[first]
        # each term's root
        self.term = term

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The ``k`` best ``(score, doc_id)`` above 0, of equal scores those of smaller ids."""
        place = np.searchsorted(self.term, terms)
        there = place < len(self.term)
        there[there] = self.term[place[there]] == terms[there]
        top, entries, own = len(self.at) - 1, place[there], weights[there]
        if not len(entries):
            return []
        best: list[tuple[int, int]] = []  # (score, -doc_id), the worst first
        count = 0
        queue = [(-int((self.most[top][entries] * own).sum()), count, top, entries, own)]
        while queue:
            bound, _, level, entries, own = heapq.heappop(queue)
            if -bound <= 0 or len(best) == k and -bound < best[0][0]:
                break
            if level:
                low, n = self.child[level][entries], self.child[level][entries + 1] - self.child[level][entries]
                entries = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                own, level = np.repeat(own, n), level - 1
            where = self.at[level][entries]
            order = np.argsort(where, kind="stable")
            entries, own, where = entries[order], own[order], where[order]
            cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            sums = np.add.reduceat(self.most[level][entries] * own, cuts)
            stops = np.append(cuts[1:], len(where))
            for at, stop, total in zip(cuts.tolist(), stops.tolist(), sums.tolist(), strict=True):
                if total <= 0 or len(best) == k and total < best[0][0]:
                    continue
                if level:
                    count += 1
                    heapq.heappush(queue, (-total, count, level, entries[at:stop], own[at:stop]))
                else:
                    found = (total, -int(self.ids[where[at]]))
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
            if not level and not top:
                break
        return [(score, -doc) for score, doc in best]


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _words_of(text: str | None) -> set[bytes]:
    found: set[bytes] = set()
    for _, _, start, end, part in tv.words(*tv.column_bytes(pa.array([text or ""])), tv.ALNUM):
        found.update(part[a:b].tobytes() for a, b in zip(start, end, strict=True))
    return found


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best of ``docs(doc_id, text)`` for each of ``items(item_id, text)``.

    Terms are runs of letters, digits and non-ASCII characters, A-Z
    lower-cased, of a whole text. Null and empty texts have none. Only scores
    above 0 count; ties go to smaller doc_ids. Rows that repeat a doc_id are
    ranked one by one; rows with a null doc_id take no part; rows that repeat
    an item_id are one item with the terms of all; a null item_id is none. An
    empty table gives an empty result; a very long text is read in blocks.
    Other columns are not read. Items of up to about ``pass_bytes`` are
    answered in one pass over the documents.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    asked = asked.withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(passes)))
    out = None
    with temporary() as keep:
        for p in range(passes):
            found = keep(written(_one_pass(texts, asked.where(F.col("pass") == p), k, shard_docs, shard_postings), "ranked"))
            out = found if out is None else out.union(found)
    return out


def _one_pass(texts: DataFrame, asked: DataFrame, k: int, shard_docs: int, shard_postings: int) -> DataFrame:
    spark, kind = texts.sparkSession, asked.schema["item_id"].dataType
    of_item: dict = {}
    for r in asked.select("item_id", "text").collect():  # about PASS_BYTES
        of_item.setdefault(r["item_id"], set()).update(_words_of(r["text"]))
    terms = sorted(set().union(*of_item.values()))
    number = {t: i for i, t in enumerate(terms)}
    shards = written(index(texts, terms, shard_docs, shard_postings), "shards")
    n = shards.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("words")).first()
    documents, words = n["docs"] or 0, n["words"] or 0
    pairs = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).select("p.terms", "p.df")
    df = {r["terms"]: r["df"] for r in pairs.groupBy("terms").agg(F.sum("df").alias("df")).collect()}  # a row for each term of the pass
    queries = []
    for item, own in of_item.items():
        known = [i for i in sorted(number[t] for t in own) if i in df]
        queries.append((item, np.array(known, np.int64), np.array([weight(documents, df[i]) for i in known], np.int64)))
    sent = spark.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                shard, found = Shard(packed.as_py(), documents, words), []
                for item, own, weights in sent.value:
                    found += [(item, doc, score) for score, doc in shard.search(own, weights, k)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["item_id", "doc_id", "score"])

    best = shards.select("shard").mapInArrow(search, f"item_id {kind.simpleString()}, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items are cut into parts of bounded size, and each
part's automaton is built in a task and kept as flat arrays, which are sent to
the executors. Training texts are streamed through all of them in one pass; the
longest matching length at each word tells which benchmark windows end there.
Where four words together may be an item's, by their hashes, the words are
compared with the items' byte by byte, so nothing rests on equal hashes. No
text is shuffled.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textvec as tv
from sparkloom.llm.common import written

#: Words of a part, and of all parts that one pass over the texts applies: some 100 bytes each in every Python worker.
PART_WORDS, PASS_WORDS = 250_000, 1_000_000
#: Transitions that a task keeps at hand.
AT_HAND = 1 << 18
#: The same words that ``tv.ALNUM`` finds in lower-cased bytes.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


class SuffixAutomaton:
    """All word windows of a set of items ``(item, word numbers)``; see :class:`Matcher`."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        items = [(i, w) for i, w in items if w]
        for _, w in items:
            last = 0
            for c in w:
                last = self._extend(last, c)
        self.items: list[set] = [set() for _ in self.next]
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for item, w in items:
            at = 0
            for c in w:
                at = self.next[at][c]
                u = at
                while u > 0 and item not in self.items[u]:
                    self.items[u].add(item)
                    u = self.link[u]
            if len(w) < window:
                while self.len[self.link[at]] >= len(w):
                    at = self.link[at]
                self.short[at].append((len(w), item))
        self.least = min([window, *(len(w) for _, w in items)])
        self.held = [w for _, w in items]

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of p's longest string and c, cut off q where q's is longer."""
        if self.len[q] == self.len[p] + 1:
            return q
        copy = self._new(self.len[p] + 1)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new, p = self._new(self.len[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, self.next[p][c], c)
        return new

    def flat(self, words: list[bytes]) -> dict:
        """All that :class:`Matcher` needs, in arrays; ``words`` are the bytes of the words by number."""
        count = np.array([len(n) for n in self.next], np.int64)
        state = np.repeat(np.arange(len(count)), count)
        word = np.array([c for n in self.next for c in n], np.int64)
        to = np.array([t for n in self.next for t in n.values()], np.int32)
        key = state * max(1, len(words)) + word
        order = np.argsort(key)
        item_ids = np.array([i for at in self.items for i in sorted(at)], np.int64)
        gram, hashes = min(self.least, len(_C)), tv.Terms(words).own
        found = [grams(hashes[np.array(w, np.int64)], gram) for w in self.held]
        return {
            "window": self.window, "least": self.least, "gram": gram, "grams": np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64), "words": words, "key": key[order], "to": to[order],
            "link": np.array(self.link, np.int32), "len": np.array(self.len, np.int32), "items": item_ids, "items_at": np.concatenate([[0], np.cumsum([len(at) for at in self.items])]).astype(np.int64),
            "short": {k: v for k, v in enumerate(self.short) if v},
        }


class Matcher:
    """Finds benchmark windows in texts by a :class:`SuffixAutomaton`'s arrays. Transitions that were followed of late are kept at hand."""

    def __init__(self, flat: dict):
        self.__dict__.update(flat)
        self.size = max(1, len(self.words))
        self.terms = tv.Terms(self.words)
        self.followed: dict[int, int] = {}
        self.named: dict[int, frozenset] = {}
        self.flags = np.zeros(1 << 22, bool)
        self.flags[self.grams & np.uint64(len(self.flags) - 1)] = True

    def _step(self, at: int, word: int) -> int:
        """The state after a word, or -1."""
        key = at * self.size + word
        found = self.followed.get(key)
        if found is None:
            i = int(np.searchsorted(self.key, key))
            found = int(self.to[i]) if i < len(self.key) and self.key[i] == key else -1
            if len(self.followed) >= AT_HAND:
                self.followed.clear()
            self.followed[key] = found
        return found

    def _items(self, state: int) -> frozenset:
        if state not in self.named:
            if len(self.named) >= AT_HAND >> 4:
                self.named.clear()
            self.named[state] = frozenset(self.items[self.items_at[state] : self.items_at[state + 1]].tolist())
        return self.named[state]

    def feed(self, numbers: np.ndarray) -> Iterator[tuple[int, int, frozenset]]:
        """``(end, length, items)`` for each benchmark window that ends after word ``end``; ``numbers`` are the words', -1 for one of no item."""
        at = length = 0
        for i, word in enumerate(numbers.tolist()):
            if word < 0:
                at = length = 0
                continue
            following = self._step(at, word)
            while at and following < 0:
                at = int(self.link[at])
                length = int(self.len[at])
                following = self._step(at, word)
            if following < 0:
                continue
            at, length = following, length + 1
            if length < self.least:
                continue
            u, here = at, length
            while u > 0:
                up = int(self.link[u])
                if here >= self.window > self.len[up]:
                    yield i, self.window, self._items(u)
                for n, item in self.short.get(u, ()):
                    if n <= here:
                        yield i, n, frozenset([item])
                u, here = up, int(self.len[up])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n or n < 1:
        return np.zeros(0, np.uint64)
    total = h[: len(h) - n + 1] * _C[0]
    for k in range(1, n):
        total = total + h[k : len(h) - n + 1 + k] * _C[k]
    return tv.mix(total)


def _item_words(text: str | None) -> list[bytes]:
    buf, offsets = tv.column_bytes(pa.array([text or ""]))
    return [part[a:b].tobytes() for _, start, end, part in tv.ranges(buf, offsets, tv.ALNUM) for a, b in zip(start, end, strict=True)]


def _matches(matchers: list[Matcher], column: pa.Array) -> Iterator[tuple[int, set, set]]:
    """Each text's number of words, the set of hit words, and the items found."""
    for a, b in tv.slices(column):
        found = tv.Words(*tv.column_bytes(column.slice(a, b - a)), tv.ALNUM)
        h, begin = found.hashes, found.begin
        doc = np.repeat(np.arange(b - a), np.diff(begin))
        hits: dict[int, tuple[set, set]] = {}
        for m in matchers:
            g, n = grams(h, m.gram), m.gram
            if not len(g):
                continue
            good = m.flags[g & np.uint64(len(m.flags) - 1)] & (doc[: len(g)] == doc[n - 1 :])
            # windows lie in runs of grams that the benchmark holds
            edges = np.diff(np.concatenate([[0], good.view(np.int8), [0]]))
            cut = np.zeros(len(good) + 1, bool)
            cut[begin[(begin > 0) & (begin < len(good))]] = True
            starts = np.flatnonzero((edges == 1) | (cut & np.append(good, False)))
            stops = np.flatnonzero((edges == -1) | (cut & np.append(False, good)))
            for s, e in zip(starts, stops, strict=True):
                if e - s + n - 1 >= m.least:
                    d, run = int(doc[s]), slice(s, e + n - 1)
                    numbers = m.terms.find(h[run], found.eights, found.start[run], found.end[run])
                    for end, length, items in m.feed(numbers):
                        where, which = hits.setdefault(d, (set(), set()))
                        last = s + end - begin[d]
                        where.update(range(int(last) - length + 1, int(last) + 1))
                        which |= items
        for d in range(b - a):
            where, which = hits.get(d, (set(), set()))
            yield int(begin[d + 1] - begin[d]), where, which


def automata(benchmark: DataFrame, window: int, part_words: int) -> DataFrame:
    """``part, words, flat`` (pickled arrays) of a benchmark cut into parts of about ``part_words`` words, each built in a task."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    # a word has a letter and a gap at least, so half the bytes bound the words
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(total) // (2 * part_words)))

    def build(part: pa.Table) -> pa.Table:
        rows = sorted((i, tuple(_item_words(t))) for i, t in zip(part["item_id"].to_pylist(), part["text"].to_pylist(), strict=True))
        words = sorted({x for _, w in rows for x in w})
        number = {x: k for k, x in enumerate(words)}
        flat = SuffixAutomaton([(i, [number[x] for x in w]) for i, w in rows], window).flat(words)
        return pa.table({"part": part["part"][:1], "words": pa.array([sum(len(w) for _, w in rows)], pa.int64()), "flat": pa.array([pickle.dumps(flat)], pa.binary())})

    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    return written(dealt.groupBy("part").applyInArrow(build, "part int, words long, flat binary"), "automata")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, part_words: int = PART_WORDS, pass_words: int = PASS_WORDS, then: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` (word numbers from 0) and ``hit_items``.

    A window is ``window`` consecutive words of an item, or a whole item of
    fewer words; words are runs of letters, digits and non-ASCII characters,
    A-Z lower-cased. Null texts have no words; items without words, and null
    item ids, match nothing; repeated items and rows count like one each. A very
    long text is read in blocks. An empty table stays empty, and an empty
    benchmark hits nothing. The automata of up to ``pass_words`` words are sent
    to the executors at once; more take further passes, each written before the
    next begins. Words are matched by their bytes. The three names replace
    columns of ``docs``. ``then`` is applied to the rows in the tasks of the last
    pass, so that no second Python worker stands beside each, and leaves the
    other columns.
    """
    spark = docs.sparkSession
    built = automata(benchmark, window, part_words)
    passes, room = [[]], 0
    for r in built.select("part", "words").orderBy("part").collect():  # a row for each part
        if passes[-1] and room + r["words"] > pass_words:
            passes.append([])
            room = 0
        passes[-1].append(r["part"])
        room += r["words"]
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "hit_words", "hit_items")]
    out = docs.select(*kept).withColumns({"n_words": F.lit(0).cast("long"), "hit_words": F.array().cast("array<int>"), "hit_items": F.array().cast("array<long>")})
    at = kept.index("text")
    for k, parts in enumerate(passes):
        # the passes before are done and written, so a task holds the automata of one pass
        out = written(out, "matched") if k else out
        flats = [bytes(r["flat"]) for r in built.where(F.col("part").isin(parts)).select("flat").collect()]
        sent = spark.sparkContext.broadcast(flats)
        last = then if k == len(passes) - 1 else None

        def apply(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            matchers = [Matcher(pickle.loads(f)) for f in sent.value]
            for batch in batches:
                n, where, which = [], batch.column(len(kept) + 1).to_pylist(), batch.column(len(kept) + 2).to_pylist()
                for i, (words, hit, items) in enumerate(_matches(matchers, batch.column(at))):
                    n.append(words)
                    if hit:
                        where[i], which[i] = sorted({*where[i], *hit}), sorted({*which[i], *items})
                arrays = [*batch.columns[: len(kept)], pa.array(n, pa.int64()), pa.array(where, pa.list_(pa.int32())), pa.array(which, pa.list_(pa.int64()))]
                found = pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)
                yield from last(found) if last else [found]

        out = out.mapInArrow(apply, out.select(*kept).schema if last else out.schema)
    return out


def report(found: DataFrame) -> DataFrame:
    """Per document: counts and the digest of the items found."""
    names = F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without benchmark passages.

    Spans of hit words are cut from the text, from the first to the last
    character of each; a document of which more than ``max_coverage`` of the
    words are hit goes. Others are returned as they were, those with null and
    empty texts too. Repeated rows are treated alike, all columns are kept
    whatever their names, an empty table stays empty.
    """
    given = docs.columns
    at = given.index("text")
    # other names, so that none clashes with the columns added
    names = [c if i == at else f"column_{i}" for i, c in enumerate(given)]
    plain = docs.toDF(*names)

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in tv.slices(batch.column(at)):
            part = batch.slice(a, b - a)
            words, hits = (part.column(len(names) + k).to_pylist() for k in range(2))
            keep = [len(hit) <= n * max_coverage for n, hit in zip(words, hits, strict=True)]
            columns = list(part.columns[: len(names)])
            if any(hits):
                texts = [without_words(t.as_py(), hit) if hit and stays else t.as_py() for t, hit, stays in zip(part.column(at), hits, keep, strict=True)]
                columns[at] = pa.array(texts, part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return find_contamination(plain, benchmark, window, then=cut).toDF(*given)


def without_words(text: str, hit: list[int]) -> str:
    """The text without the spans of these (sorted) word numbers."""
    spans = [m.span() for m in WORD.finditer(text)]
    out, at, i = [], 0, 0
    while i < len(hit):
        j = i
        while j + 1 < len(hit) and hit[j + 1] == hit[j] + 1:
            j += 1
        out.append(text[at : spans[hit[i]][0]])
        at = spans[hit[j]][1]
        i = j + 1
    return "".join(out) + text[at:]


def items_digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()

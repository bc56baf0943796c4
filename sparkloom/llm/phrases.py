"""Phrase collocations by pattern growth over contiguous words.

As in PrefixSpan, a frequent prefix has a projected database: what follows its
occurrences. It is grown to the right depth first, and a longer prefix projects
only the occurrences of the one before. The reading tasks project: an
occurrence points at its following words, up to the first that is not frequent
or, with the word before it, no frequent pair; equal ones are counted together
before they are shuffled. A task gets whole prefixes in sorted order, so an
occurrence list is a run of rows and its extensions are runs within it. A
prefix with a large share of all words is parted by what follows it; the counts
of the parts are summed.

Words travel as 64-bit numbers. These are made for the corpus: all its words
are counted by their letters first, and if a frequent word shares its number
with any other word, all numbers are drawn anew.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm import textvec as tv
from sparkloom.llm.common import temporary, written

LEAST, LONGEST, MOST, CONTAINED = 10, 3, 2000, 50
#: Bytes of texts that are split at once, and distinct words and occurrences that a reading task counts together.
BLOCK, WORDS_HELD, ROWS_HELD = 1 << 20, 1 << 18, 1 << 20
#: A prefix with more than one in PARTS of all words is parted; at most PARTS are.
PARTS = 4096
#: Parts of a lang's phrases that are ranked at first.
SALTS = 64
#: Bits an item takes in a filter, and the most bits of a filter, which is broadcast (16 MB).
FILTER_BITS, MOST_BITS = 16, 1 << 27
#: Bits of a word's code in a reading task: it holds WORDS_HELD words and those of a block at most.
CODE = 21
UNKNOWN = "und"

_CAPITALS, _ENDS = bytes(range(65, 91)), b".,;:!?\x0b\x0c\r"
_PLAIN = bytes.maketrans(_CAPITALS + _ENDS + b"\t", _CAPITALS.lower() + b"\n" * len(_ENDS) + b" ")
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)]


def pieces(text: bytes) -> list[bytes]:
    """Words of a text in order, with ``b"\\n"`` between pieces."""
    return [w for w in text.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ") if w]


def streams(langs: pa.Array, column: pa.Array, block: int = BLOCK) -> Iterator[tuple[str, list[bytes], bool]]:
    """``lang, words, ends``: the texts of a batch as one stream for each lang, in blocks that cut no word; ends with its last block."""
    for at, stop in tv.slices(column):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(langs.slice(at, stop - at).to_pylist(), column.slice(at, stop - at).cast(pa.large_binary()).to_pylist(), strict=True):
            if text:
                texts.setdefault(UNKNOWN if lang is None else lang, []).append(text)
        for lang, own in texts.items():
            joined = b"\n".join(own)
            a = 0
            while a < len(joined):
                b = min(len(joined), a + block)
                if b < len(joined):
                    gap = max(joined.rfind(b" ", a, b), joined.rfind(b"\n", a, b))
                    if gap < a:
                        gaps = [g for g in (joined.find(b" ", b), joined.find(b"\n", b)) if g >= 0]
                        gap = min(gaps, default=len(joined) - 1)
                    b = gap + 1
                yield lang, pieces(joined[a:b]), b == len(joined)
                a = b


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n``: all word occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counts.pop(b"\n", None)
                words = pa.array(counts.keys(), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), words, pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, words, _ in streams(batch.column(0), batch.column(1)):
                held.setdefault(lang, Counter()).update(words)
                if sum(map(len, held.values())) > WORDS_HELD:
                    yield from out()
        yield from out()

    return _rows(docs).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered_words(words: DataFrame, least: int, bits: int = 64) -> tuple[DataFrame, int]:
    """``lang, word, n, h`` of the words that occur ``least`` times, and the draw of the numbers ``h``.

    No other word of ``words(lang, word, n)`` has the number of one of these,
    and none is 0. ``bits`` are kept of a number, fewer than 64 only to try what equal ones do.
    """
    for draw in range(1000):
        h = F.xxhash64(F.concat(F.lit(f"{draw} "), "lang"), "word").bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
        named = words.withColumn("h", h)
        shared = named.groupBy("h").agg(F.count("*").alias("words"), F.max("n").alias("most")).where((F.col("most") >= least) & ((F.col("words") > 1) | (F.col("h") == 0)))
        if shared.isEmpty():
            return named.where(F.col("n") >= least), draw
    raise RuntimeError("no draw tells the words apart")


def _number(lang: str, draw: int, bits: int) -> Callable[[bytes], int]:
    """The ``h`` of a word of this lang, as Spark works it out."""
    seed, mask = xxhash.xxh64_intdigest(f"{draw} {lang}".encode(), 42), (1 << bits) - 1
    return lambda word: xxhash.xxh64_intdigest(word, seed) & mask


class Filter:
    """A bitmap of some numbers, or of pairs of numbers: none is missed, few others pass."""

    def __init__(self, keys: DataFrame):
        """``keys`` has one column or two, of numbers."""
        n, bits = keys.count(), 1 << 16
        while bits < min(MOST_BITS, FILTER_BITS * n):
            bits *= 2
        self.bits = bits

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = self.places(*[c.to_numpy().view(np.uint64) for c in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(5)).astype(np.int64)), pa.array(np.int64(1) << (at & np.uint64(31)).astype(np.int64))], names=["cell", "bit"])

        cells = keys.mapInArrow(place, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("held"))
        self.map = np.zeros(bits // 32, np.uint32)
        found = cells.toArrow()  # bits / 32 rows at most
        self.map[found["cell"].to_numpy()] = found["held"].to_numpy().astype(np.uint32)

    def places(self, *columns: np.ndarray) -> np.ndarray:
        at = columns[0] * _C[0]
        for c in columns[1:]:
            at = tv.mix(at) + c * _C[1]
        return tv.mix(at) & np.uint64(self.bits - 1)

    def holds(self, *columns: np.ndarray) -> np.ndarray:
        at = self.places(*columns)
        return self.map[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1) > 0


class Projection:
    """Occurrences of frequent words in one lang, each with up to ``longest - 1`` words that follow, counted together.

    An occurrence is cut before the first word that ``words`` doesn't hold and,
    where there is such a filter, before a word that makes no pair that
    ``pairs`` holds with the one before. Shorter ones than ``least`` words are left out.
    """

    def __init__(self, number: Callable[[bytes], int], longest: int, least: int, words: Filter, pairs: Filter | None):
        self.number, self.longest, self.least, self.words, self.pairs = number, longest, least, words, pairs
        self.carried: list[bytes] = []
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {b"\n": 0}
        self.numbers = [np.zeros(1, np.uint64)]
        self.rows: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size, self.held = 1, 0

    def _learn(self, words: set[bytes]) -> None:
        """Codes for new words; 0 for those that are not frequent, as for a break."""
        new = list(words.difference(self.index))
        h = np.fromiter(map(self.number, new), np.uint64, len(new))
        good = self.words.holds(h) if len(h) else np.zeros(0, bool)
        codes = np.where(good, self.size + np.cumsum(good) - 1, 0)
        self.index.update(zip(new, codes.tolist(), strict=True))
        self.numbers.append(h[good])
        self.size += int(good.sum())

    def add(self, words: list[bytes], ends: bool) -> None:
        k = self.longest - 1
        words = self.carried + words
        # the last words wait for what follows them
        self.carried = [] if ends else words[len(words) - k :] if len(words) > k else words
        if not ends and len(words) <= k:
            return
        self._learn(set(words))
        codes = list(map(self.index.__getitem__, words)) + [0] * (k if ends else 0)
        flat = np.array(codes, np.int64)
        n = len(flat) - k
        table = [flat[j : n + j] for j in range(self.longest)]
        good = table[0] > 0
        if self.pairs is not None:
            self.numbers = [np.concatenate(self.numbers)]
            h = self.numbers[0][flat]
            linked = np.append((flat[:-1] > 0) & (flat[1:] > 0), False)
            some = np.flatnonzero(linked)
            linked[some] = self.pairs.holds(h[some], h[some + 1])
        else:
            linked = np.ones(len(flat), bool)
        columns, alive = [table[0]], good
        for j in range(1, self.longest):
            alive = alive & (table[j] > 0) & linked[j - 1 : n + j - 1]
            columns.append(np.where(alive, table[j], 0))
        keep = np.flatnonzero(columns[self.least - 1] > 0)
        self.rows.append(np.stack([c[keep] for c in columns]).astype(np.int32))
        self.counts.append(np.ones(len(keep), np.int64))
        self.held += len(keep)

    def fold(self) -> None:
        """Counts equal rows together."""
        table, counts = np.concatenate(self.rows, axis=1), np.concatenate(self.counts)
        key = table[0].astype(np.int64)
        for j in range(1, self.longest):
            if j > 2:
                key = np.unique(key, return_inverse=True)[1]
            key = key << CODE | table[j]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.rows, self.counts = [table[:, order[first]]], [np.add.reduceat(counts[order], first) if len(first) else counts]
        self.held = len(first)

    def full(self) -> bool:
        """Whether it holds enough to be sent on; many occurrences are first counted together."""
        if self.held > 2 * ROWS_HELD:
            self.fold()
            return self.held > ROWS_HELD or len(self.index) > WORDS_HELD
        return len(self.index) > WORDS_HELD

    def out(self) -> Iterator[pa.RecordBatch]:
        """The rows so far: numbers ``h0, h1, ...``, 0 after the last, and ``n``."""
        if self.rows:
            self.fold()
            numbers = np.concatenate(self.numbers).view(np.int64)
            names = [*(f"h{j}" for j in range(self.longest)), "n"]
            for a in range(0, self.held, 1 << 16):
                part = self.rows[0][:, a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([*(pa.array(numbers[c]) for c in part), pa.array(self.counts[0][a : a + (1 << 16)])], names=names)
        self.clear()


def projections(docs: DataFrame, draw: int, bits: int, longest: int, least: int, words: Filter, pairs: Filter | None = None) -> DataFrame:
    """``h0, ..., n``: the projected databases of the frequent words; see :class:`Projection`."""
    sent = docs.sparkSession.sparkContext.broadcast((words, pairs))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Projection] = {}
        for batch in batches:
            for lang, found, ends in streams(batch.column(0), batch.column(1)):
                if lang not in held:
                    held[lang] = Projection(_number(lang, draw, bits), longest, least, *sent.value)
                held[lang].add(found, ends)
                if held[lang].full():
                    yield from held[lang].out()
        for own in held.values():
            yield from own.out()

    return _rows(docs).mapInArrow(project, ", ".join([*(f"h{j} long" for j in range(longest)), "n long"]))


def grow(columns: list[np.ndarray], counts: np.ndarray, parted: np.ndarray, begin: int, least: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Extensions of sorted occurrences, from ``begin`` words on: their words and counts, level by level within the runs that stay.

    A run of rows with equal first words is an extension; one with too few
    occurrences is dropped, and so are its own extensions. Runs at the ends may
    go on in other rows, and those of a parted prefix in other parts, so they stay.
    """
    ends = np.zeros(len(counts), bool)
    if len(ends):
        ends[[0, -1]] = True
    for length in range(begin, len(columns) + 1):
        there = columns[length - 1] != 0
        columns, counts, parted, ends = [c[there] for c in columns], counts[there], parted[there], ends[there]
        if not len(counts):
            return
        new = np.zeros(len(counts), bool)
        new[0] = True
        for c in columns[:length]:
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        sums = np.add.reduceat(counts, first)
        open_ = np.logical_or.reduceat(ends, first) | (parted[first] & (length < len(columns)))
        stay = (sums >= least) | open_
        yield [c[first[stay]] for c in columns[:length]], sums[stay]
        rows = np.repeat(stay, np.diff(np.append(first, len(counts))))
        columns, counts, parted, ends = [c[rows] for c in columns], counts[rows], parted[rows], ends[rows]


def longer_phrases(docs: DataFrame, known: DataFrame, pairs: DataFrame, total: int, draw: int, bits: int, least: int, longest: int, words: Filter) -> DataFrame:
    """``phrase (array of numbers), n`` of phrases of 3 to ``longest`` words with ``n >= least``, grown from the frequent pairs."""
    rows = projections(docs, draw, bits, longest, 3, words, Filter(pairs.select("h0", "h1")))
    # shares of all words sum to one, so these are PARTS rows at most
    hot = known.where(F.col("n") * PARTS > total).select(F.col("h").alias("h0"), F.ceil(F.col("n") * PARTS / F.lit(max(total, 1))).alias("parts"))
    tail = [f"h{j}" for j in range(1, longest)]
    rows = rows.join(F.broadcast(hot), "h0", "left")
    rows = rows.select("h0", F.when(F.col("parts") > 1, F.pmod(F.xxhash64(*tail), "parts")).alias("part"), *tail, "n")
    dealt = rows.repartition("h0", "part").sortWithinPartitions("h0", "part", *tail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(0).to_numpy(), *(batch.column(j).to_numpy() for j in range(2, longest + 1))]
            for found, sums in grow(columns, batch.column(longest + 1).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False), 3, least):
                flat = np.stack(found, axis=1).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * len(found)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([lists, pa.array(sums)], names=["phrase", "n"])

    grown = dealt.mapInArrow(run, "phrase array<long>, n long")
    return grown.groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def mine_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, contained: int = CONTAINED, bits: int = 64) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each lang's first ``most`` collocations of ``docs(lang, text, ...)``.

    Phrases of 2 to ``longest`` words within a piece that occur at least
    ``least`` times. A phrase is cut where its score, ``1000000 a a`` over ``l r``
    (rounded down, exactly), is lowest, first of equals. Those that lie in a
    longer candidate with ``100 f >= contained a`` are left out. Ranked by
    score and ``a``, largest first, and by the phrase's bytes.

    Null texts and empty ones have no words; a null lang is ``und``, as is one
    of that name; repeated rows count again; an empty table gives an empty
    result. A very long text is read in blocks. Other columns are not read.
    """
    with temporary() as keep:
        words = written(word_counts(docs), "words")
        totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
        total = words.agg(F.sum("n")).first()[0] or 0
        named, draw = numbered_words(words, least, bits)
        named = written(named, "frequent-words")
        filter_ = Filter(named.select("h"))
        # both words of a pair must be frequent in truth, not for the filter alone
        pairs = projections(docs, draw, bits, 2, 2, filter_).groupBy("h0", "h1").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        pairs = pairs.join(named.select(F.col("h").alias("h0")), "h0", "left_semi").join(named.select(F.col("h").alias("h1")), "h1", "left_semi")
        pairs = written(pairs.select("h0", "h1", "n"), "pairs")
        longer = pairs.select(F.array("h0", "h1").alias("phrase"), "n")
        if longest > 2:
            longer = written(longer.union(longer_phrases(docs, named, pairs, total, draw, bits, least, longest, filter_)), "phrases")
        known = longer.union(named.select(F.array("h").alias("phrase"), "n"))
        size = F.size("phrase")
        cuts = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(k.alias("k"), F.slice("phrase", F.lit(1), k).alias("head"), F.slice("phrase", k + 1, size - k).alias("rest")))
        cut = longer.select("phrase", F.col("n").alias("a"), F.explode(cuts).alias("c")).select("phrase", "a", "c.*")
        cut = cut.join(known.toDF("head", "l"), "head").join(known.toDF("rest", "r"), "rest")
        exact = lambda c: F.col(c).cast("decimal(15,0)")
        above, below = (F.lit(1000000).cast("decimal(7,0)") * exact("a") * exact("a")).alias("above"), (exact("l") * exact("r")).alias("below")
        cut = cut.select("phrase", "a", "k", "l", "r", above, below).withColumn("score", F.expr("above div below"))
        best = cut.groupBy("phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("phrase", "a", "c.*")
        inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("phrase", i, m))))
        around = best.where(size > 2).select(F.explode(inner).alias("phrase"), F.col("a").alias("around")).groupBy("phrase").agg(F.max("around").alias("around"))
        left = best.join(around, "phrase", "left").where(F.coalesce(100 * F.col("around") < contained * F.col("a"), F.lit(True)))
        # by numbers first, ties included, so that few phrases are spelt out
        left = left.withColumn("h", F.col("phrase")[0]).join(named.select("h", "lang"), "h")
        best_first = [F.desc("score"), F.desc("a")]
        # the best of each of SALTS parts of a lang, so that no task ranks all of its phrases
        parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*best_first)
        left = left.withColumn("rank", F.rank().over(parts)).where(F.col("rank") <= most)
        order = Window.partitionBy("lang").orderBy(*best_first)
        first = written(left.withColumn("rank", F.rank().over(order)).where(F.col("rank") <= most).select("lang", "phrase", "a", "l", "r", "score"), "ranked-phrases")
        spelt = first.select("phrase", F.posexplode("phrase").alias("k", "h")).join(named.select("h", "word"), "h")
        spelt = spelt.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("words"))
        shown = first.join(spelt, "phrase").withColumn("phrase", F.array_join(F.transform("words", lambda w: w["word"]), " "))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = shown.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
        return keep(written(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"), "collocations"))

"""Phrases, ranked search and mixing against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing, phrases, ranked
from sparkloom.llm import textvec as tv

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_phrases(rows, least=10, longest=3, most=2000, contained=50):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[ \t]", piece) if x]
            total[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        left = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= contained * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, _, low, rest = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            left.append((-score, -a, " ".join(p).encode(), low, rest))
        for rank, (score, a, p, low, rest) in enumerate(sorted(left)[:most], 1):
            out.append((lang, rank, p.decode(), -a, low, rest, total[lang], -score))
    return Counter(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"Word": F.lit("x"), "n": F.lit(1)}).repartition(3)
    return Counter(map(tuple, phrases.mine_phrases(df, **options).collect()))


@pytest.fixture(scope="module")
def talk():
    rnd = random.Random(2)
    words = ["a", "A", "bé", "É", "cat", "dog", "e f", "\x0bg", "h.i", "the"]
    rows = [(rnd.choice(["en", "fr", None]), rnd.choice([" ", "  ", "\t"]).join(rnd.choice(words) + rnd.choice(["", "", "", ".", ",", "\n", "?!"]) for _ in range(rnd.randint(0, 60)))) for _ in range(60)]
    return rows + [("en", None), (None, ""), ("und", "the cat. the cat"), ("en", " \t. "), ("de", "one two three " * 40)] + [("en", "the same row again")] * 12


@pytest.mark.parametrize("options", [{}, {"least": 4, "longest": 4}, {"longest": 2, "most": 3}, {"least": 2, "contained": 100}])
def test_phrases(spark, talk, options):
    assert mined(spark, talk, **options) == plain_phrases(talk, **options)


def test_phrases_in_blocks_with_parted_prefixes(spark, talk, monkeypatch):
    monkeypatch.setattr(phrases, "PARTS", 2000)
    rows = [*talk, ("en", "the cat sat on " * 3000)]
    cut = [w for _, words, _ in phrases.streams(pa.array(["x"] * 3), pa.array(["one two three", "four. five", None]), 5) for w in words]
    assert cut == [b"one", b"two", b"three", b"\n", b"four", b"\n", b"five"]
    assert mined(spark, rows) == plain_phrases(rows)


def test_words_with_equal_numbers_are_drawn_anew(spark, talk):
    assert mined(spark, talk, bits=12, least=4) == plain_phrases(talk, least=4)
    words = spark.createDataFrame([("en", f"w{k}", 20) for k in range(60)], "lang string, word string, n long")
    named, draw = phrases.numbered_words(words, 10, 9)
    assert draw > 0 and len({r.h for r in named.collect()}) == 60
    number = phrases._number("en", draw, 9)
    assert all(number(r.word.encode()) == r.h for r in named.collect())


def test_projections_carry_words_over_blocks():
    class Everything:
        def holds(self, *columns):
            return np.ones(len(columns[0]), bool)

    letters = {w: k for k, w in enumerate((b"", b"a", b"b", b"c", b"d"))}
    for clear in (False, True):
        own = phrases.Projection(letters.__getitem__, 3, 2, Everything(), None)
        got = Counter()
        for k, block in enumerate([[b"a", b"b"], [b"c"], [b"\n", b"a"], [b"b", b"c", b"d"]]):
            own.add(block, k == 3)
            if clear or k == 3:
                for batch in own.out():
                    for *row, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        got[tuple(row)] += n
        assert got == Counter({(1, 2, 3): 2, (2, 3, 0): 1, (2, 3, 4): 1, (3, 4, 0): 1})


def test_phrases_of_empty_tables(spark):
    assert mined(spark, []) == Counter() and mined(spark, [("en", None)]) == Counter()


def plain_ranks(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    found = [(d, Counter(term.findall((t or "").translate(LOWER)))) for d, t in docs if d is not None]
    n, total = sum(1 for _, c in found if c), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    own = defaultdict(set)
    for i, t in items:
        if i is not None:
            own[i].update(term.findall((t or "").translate(LOWER)))
    out = Counter()
    for i, terms in own.items():
        scores = []
        for d, c in found:
            size = sum(c.values())
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * (50 + 50 * size * n // total))) for t in terms if t in c)
            if score > 0:
                scores.append((-score, d))
        for rank, (score, d) in enumerate(sorted(scores)[:k], 1):
            out[(i, rank, d, -score)] += 1
    return out


@pytest.mark.parametrize("shape", [(50, 4096, 1 << 19, 8 << 20), (3, 7, 1 << 19, 40), (5, 300, 60, 8 << 20)])
def test_ranked_search(spark, shape):
    k, shard_docs, shard_postings, pass_bytes = shape
    rnd = random.Random(7)
    words = ["ant", "Bee", "çà", "7", "dog's", "e_f", "日本", "zz" * 40] + [f"w{i}" for i in range(25)]
    text = lambda n: rnd.choice([" ", "-", "\n"]).join(rnd.choice(words) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 40))) for i in range(300)] + [(900, None), (901, ""), (902, "--"), (None, "ant"), (3, "ant bee"), (3, "ant bee"), (903, "ant " * 30000)]
    docs += [(1000 + i, "ant bee same") for i in range(60)]
    items = [(1, "Ant, bee"), (2, text(12)), (3, None), (4, "nowhere"), (2, "zz"), (None, "ant"), (5, text(30)), (6, "same"), (6, "same")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit(1), "Score": F.lit(2)}).repartition(3)
    got = Counter(map(tuple, ranked.rank_documents(df, spark.createDataFrame(items, "item_id long, text string"), k, shard_docs, shard_postings, pass_bytes).collect()))
    assert got == plain_ranks(docs, items, k)


def test_ranked_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = some.toDF("item_id", "text")
    assert ranked.rank_documents(none, items).count() == 0
    assert ranked.rank_documents(some, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in ranked.rank_documents(some, items).collect()] in ([], [(1, 1, 1)])


def test_terms_of_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(tv, "byte_hash", lambda part, a, b, seed=0: np.zeros(len(a), np.uint64))
    known = tv.Terms([b"ab", b"abcdefghij", b"abcdefghik", b"b"])
    part = np.frombuffer(b"ab abcdefghik zz abcdefghij b abc", np.uint8)
    start, end = np.array([0, 3, 14, 17, 28, 30]), np.array([2, 13, 16, 27, 29, 33])
    assert known.find(np.zeros(6, np.uint64), tv.eights(part), start, end).tolist() == [0, 2, -1, 1, 3, -1]


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = Fraction(total - sum(most * sizes[s] for s in full))
        open_ = [s for s in names if s not in full]
        share = rest / sum(weight[s] for s in open_) if open_ else 0
        more = {s for s in open_ if share * weight[s] >= most * sizes[s]}
        if not more:
            return {s: float(most * sizes[s] if s in full else share * weight[s]) for s in names}
        full |= more


def mixture(spark, docs, **options):
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({"Size": F.lit("x"), "target": F.lit(3)})
    rows, mixed = mixing.mix(df.repartition(3), **options)
    return mixing.taken_words(rows, mixed).collect(), mixed.collect()


def test_mixing(spark):
    rnd = random.Random(4)
    docs = [(i, rnd.choice(["a", "b", "b", "b", "é", "Z", None]), rnd.choice([" ", "\n\t"]).join("w" for _ in range(rnd.choice([0, 3, 20, 50, 400])))) for i in range(600)]
    docs += [(7, "b", "x y z")] * 40 + [(None, "a", "one"), (None, None, None), (1000, "tiny", "one two"), (1001, "none", ""), (1002, "big", "v " * 200000)]
    out, mixed = mixture(spark, docs, shard_words=4000)
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((d, len((t or "").split())) for d, _, t in docs)
    sizes = Counter({s: 0 for _, s, _ in docs})
    for _, s, t in docs:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    words = Counter()
    for r in mixed:
        words[r.source] += r["size"]
    largest = {s: max(len((t or "").split()) for _, x, t in docs if x == s) for s in sizes}
    assert all(abs(words[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    by_source = {(r.source_size, round(r.target, 6)) for r in out}
    assert by_source == {(sizes[s], round(want[s], 6)) for s in sizes}
    assert all(r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"] for r in out) and sum(r.taken for r in out) == sum(words.values())
    again, mixed_again = mixture(spark, docs, shard_words=4000)
    assert Counter(map(tuple, out)) == Counter(map(tuple, again)) and Counter(map(tuple, mixed)) == Counter(map(tuple, mixed_again))
    for shard in {r.shard for r in mixed}:
        assert sorted(r.place for r in mixed if r.shard == shard) == list(range(sum(r.shard == shard for r in mixed)))


def test_mixing_of_empty_tables_and_many_sources(spark, monkeypatch):
    assert mixture(spark, []) == ([], [])
    assert [r.taken for r in mixture(spark, [(1, "a", None), (2, None, " ")])[0]] == [0, 0]
    monkeypatch.setattr(mixing, "LINES", 4)
    docs = [(i, f"s{i % 30}", "w " * (1 + i % 7)) for i in range(900)]
    out, mixed = mixture(spark, docs)
    assert len(out) == 900 and abs(sum(r.taken for r in out) - sum(1 + i % 7 for i in range(900))) <= 30 * 4


@pytest.mark.parametrize("shards", [1, 2, 7, 32])
def test_the_splitting_tree_deals_each_block_once(shards):
    quotas = np.array([5, 0, 130, 64, 1], np.int64)
    found = list(mixing.split(quotas, np.zeros(5, np.int64), 0, shards, shards, 3, (0, shards), int(quotas.sum())))
    assert [s for s, _, _ in found] == list(range(shards))
    sizes = [int(c.sum()) for _, _, c in found]
    assert max(sizes) - min(sizes) <= 1
    for line in range(5):
        at = 0
        for _, starts, counts in found:
            assert starts[line] == at
            at += counts[line]
        assert at == quotas[line]
    # a part of the tree gives the same as the whole
    part = [x for s in range(shards) for x in mixing.split(quotas, np.zeros(5, np.int64), 0, shards, shards, 3, (s, s + 1), int(quotas.sum()))]
    assert all(a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(found, part, strict=True))


def test_the_draws_are_hypergeometric():
    quotas = np.array([30, 10], np.int64)
    draws = [next(mixing.split(quotas, np.zeros(2, np.int64), 0, 2, 2, seed, (0, 1), 40))[2][1] for seed in range(3000)]
    assert abs(np.mean(draws) - 5) < 0.1 and abs(np.var(draws) - 20 * (1 / 4) * (3 / 4) * (20 / 39)) < 0.15
    a, b = mixing.permutation(36, 5)
    assert sorted((a * x + b) % 36 for x in range(36)) == list(range(36))

"""Near-duplicates, lines, packing, vectors and classifiers against brute force."""

import inspect
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common, contamination, line_dedup, linear, near_dups, nearest, packing, quality, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def groups(n, linked):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                p, q = sorted((top(i), top(j)))
                root[q] = p
    return [top(i) for i in range(n)]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (105, 101), (7, 7)] + [(200, 200 + k) for k in range(1, 30)]
    random.Random(3).shuffle(pairs)
    got = dict(map(tuple, common.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 105: 100, **{200 + k: 200 for k in range(30)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rnd = random.Random(5)
    base = [[rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 60)) for _ in range(rnd.randint(1, 90))] for _ in range(30)]
    texts = [None, "", " \n", "one", "One", "one two", "a b c"]
    for _ in range(170):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            w[rnd.randrange(len(w))] = "z" + str(rnd.randint(0, 9))
        texts.append(rnd.choice(["\t", " ", "  "]).join(w))
    family = [rnd.choice("abcdefgh") + str(rnd.randint(0, 99)) for _ in range(80)]
    for _ in range(60):  # a large region, with members on either side of the limit
        w = list(family)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = "q" + str(rnd.randint(0, 99))
        texts.append(" ".join(w))

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    want = groups(len(texts), lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "one", "x")], "doc_id long, text string, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.near_duplicates(docs).collect()}
    assert got.pop(None) == (1, None, True)
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in range(len(texts))}
    assert near_dups.near_duplicates(docs.limit(0)).count() == 0


def test_rows_after_the_cut_of_a_large_region_stay_region_rows():
    def rows(prefix, nodes):
        n = len(nodes)
        return pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array(prefix, pa.int64()), pa.array(nodes, pa.int64()), pa.array(nodes, pa.int64())], names=["tree", "prefix", "rest", "node"])

    parts = [rows([5] * 40, range(40)), rows([5] * 3, range(40, 43)), rows([5] * 4 + [6] * 3, range(43, 50)), rows([6], [50])]
    out = [r for batch in near_dups.region_rows(iter(parts), chunk=30) for r in batch.to_pylist()]
    hot = {r["a"] for r in out if r["region"] is not None}
    assert hot == set(range(47)) and len({r["region"] for r in out if r["region"] is not None}) == 1
    pairs = {(r["a"], r["b"]) for r in out if r["region"] is None}
    assert {(k, k + 1) for k in range(46)} <= pairs and {(a, b) for a in range(47, 51) for b in range(a + 1, 51)} <= pairs
    assert not any(a < 47 <= b for a, b in pairs)


def test_edit_distance_within():
    rnd = random.Random(1)
    for _ in range(2000):
        a = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 12)))
        b = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 12))) if rnd.random() < 0.3 else bytes(x for x in a if rnd.random() < 0.9)
        for k in range(4):
            assert line_dedup.within(a, b, k) == (distance(a, b) <= k)


def line_sets(docs):
    """``doc_id, number, line`` of the lines, and the numbers of those that are no first ones."""
    found = []
    for d, t in sorted(((d, t) for d, t in docs if d is not None), key=lambda d: d[0]):
        full = [x for x in (t or "").split("\n") if x]
        found += [(d, k, x.lower().strip().encode()) for k, x in enumerate(full) if x.strip()]
    top = groups(len(found), lambda i, j: found[i][2] == found[j][2] or min(len(found[i][2]), len(found[j][2])) >= 20 and distance(found[i][2], found[j][2]) <= 2)
    return sorted(found[i][:2] for i in range(len(found)) if top[i] != i)


@pytest.mark.parametrize("few", [8, 1])
def test_duplicate_lines(spark, monkeypatch, few):
    monkeypatch.setattr(line_dedup, "STRAY_BLOCK", 3), monkeypatch.setattr(line_dedup, "ROW_BLOCK", 4)
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abcdefghij klmn") for _ in range(rnd.randint(19, 40))) for _ in range(40)]
    docs = [(900, None), (901, ""), (902, "\n\n"), (None, base[0])]
    for d in range(60):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            x = bytearray(rnd.choice(base).encode())
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                k = rnd.randrange(len(x))
                if rnd.random() < 0.5:
                    x.insert(k, 120)
                else:
                    del x[k]
            lines += [x.decode().upper() if rnd.random() < 0.2 else x.decode()] + [""] * (rnd.random() < 0.2)
        docs.append((d, "\n".join(lines)))
    docs += [(1000 + k, f"{k % 9} short\n{k % 7}") for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("line", F.lit("clash"))
    assert sorted(map(tuple, line_dedup.duplicate_lines(df, few=few).collect())) == line_sets(docs)
    kept = {r.doc_id for r in line_dedup.dedup_lines(df).collect()}
    assert {900, 901, 902, None} <= kept
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_lines_that_share_parts_are_compared_in_full(spark, monkeypatch):
    """Many lines share a third or a half and are unlike; some of them are alike."""
    monkeypatch.setattr(line_dedup, "STRAY_BLOCK", 5), monkeypatch.setattr(line_dedup, "ROW_BLOCK", 7)
    rnd = random.Random(12)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    begin, end, lines = word(20), word(20), []
    for _ in range(25):
        lines += [begin + word(40), word(40) + end, begin[:15] + word(15) + end, word(4) + begin + word(20)]
    for x in rnd.sample(lines, 30):
        k = rnd.randrange(len(x))
        lines.append(rnd.choice([x[:k] + x[k + 1 :], x[:k] + "q" + x[k:], x[:k] + "zz" + x[k:], x[:k] + "q" + x[k + 1 :]]))
    docs = list(enumerate(lines))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = line_sets(docs)
    assert want
    assert sorted(map(tuple, line_dedup.duplicate_lines(df, few=2).collect())) == want


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_texts_that_break_polynomial_hashes_stay_apart(spark):
    for n in (512, 2048):  # hashed eight bytes at a time, and whole
        x, y = thue_morse(n)
        df = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")
        assert [tuple(r) for r in line_dedup.duplicate_lines(df).collect()] == [(3, 0)]
        assert sorted(r.component_id for r in near_dups.near_duplicates(df).collect()) == [1, 1, 2]
        bench = spark.createDataFrame([(7, x)], "item_id long, text string")
        assert sorted((r.doc_id, r.contaminated) for r in contamination.report(contamination.find_contamination(df, bench)).collect()) == [(1, True), (2, False), (3, True)]


def made_to_collide(first, second):
    """Two words of 24 bytes with one unkeyed hash: the second eight bytes make up for the first."""
    mix, base, mask = near_dups.tv.mix, int(near_dups.tv._BASE), (1 << 64) - 1

    def state(block):
        h = int(mix(np.array([24 * base & mask], np.uint64))[0])
        return int(mix(np.array([(h ^ int.from_bytes(block, "little")) * base & mask], np.uint64))[0])

    gap = (state(first) ^ state(second)).to_bytes(8, "little")
    return first + b"\x40" * 8 + b"zqxwvuts", second + bytes(0x40 ^ g for g in gap) + b"zqxwvuts"


def test_words_made_to_collide_stay_apart(spark):
    x, y = "dzktbfytaaaaaaaazqxwvuts", "wsjqijutuljclshrzqxwvuts"
    hashed = lambda *w: near_dups.tv.all_words(*near_dups.tv.column_bytes(pa.array(w)), near_dups.tv.NOT_SPACE, lower=False)[0]
    assert len(set(hashed(x, y).tolist())) == 1  # such pairs are easily made
    raw = made_to_collide(b"abcdefgh", b"ijklmnop")
    assert len(set(near_dups.tv.byte_hash(np.frombuffer(b"".join(raw), np.uint8), np.array([0, 24]), np.array([24, 48])).tolist())) == 1
    apart = near_dups.tv.byte_digest(np.frombuffer(b"".join(raw), np.uint8), np.array([0, 24]), np.array([24, 48]), 5)
    assert all(len(set(h.tolist())) == 2 for h in apart)
    df = spark.createDataFrame([(1, x), (2, y), (3, x[:-1] + "q"), (4, f"{x} a b"), (5, f"{y} a b"), (6, x)], "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.duplicate_lines(df.where("doc_id < 4")).collect())) == [(3, 0)]
    assert {r.doc_id: r.component_id for r in near_dups.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1}
    bench = spark.createDataFrame([(7, x)], "item_id long, text string")
    assert {r.doc_id for r in contamination.report(contamination.find_contamination(df, bench)).where("contaminated").collect()} == {1, 4, 6}
    sets = near_dups.exact_sets(pa.array([f"{x} a b", f"{y} a b", f"{x.upper()} a  b", x, y, None]), 3)
    assert sets[0].tolist() == sets[2].tolist() != sets[1].tolist() and sets[3].tolist() != sets[4].tolist() and not len(sets[5])


@pytest.mark.parametrize("bits", [4, 8])
def test_lines_with_equal_halves_are_told_apart(spark, bits):
    rnd = random.Random(bits)
    base = ["".join(rnd.choice("abcdefghij klmn") for _ in range(rnd.randint(20, 30))) for _ in range(30)]
    docs = [(d, "\n".join(rnd.choice(base)[: rnd.choice([None, -1])] for _ in range(rnd.randint(1, 3)))) for d in range(40)]
    lines = sorted({x.strip() for _, t in docs for x in t.split("\n")})
    pairs = [(x, y) for i, x in enumerate(lines) for y in lines[:i] if distance(x, y) <= 2]

    def halves(key):
        raw, ends = "".join(lines).encode(), np.cumsum([len(x) for x in lines])
        seal = line_dedup.Seal(key, bits)
        return dict(zip(lines, seal(np.frombuffer(raw, np.uint8), np.append(0, ends[:-1]), ends)[0].tolist(), strict=True))

    # a key that gives lines that are alike different halves, but many others the same
    key, own = next((k, h) for k, h in ((k, halves(k)) for k in range(1, 100_000)) if all(h[x] != h[y] for x, y in pairs))
    assert pairs and len(set(own.values())) < len(lines)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = line_dedup._duplicate_lines(df, 2, 20, 8, line_dedup.Seal(key, bits))
    assert sorted(map(tuple, got.collect())) == line_sets(docs)


def test_names_that_clash_and_long_texts_in_line_dedup(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, "one line that is long enough\nanother", 5, 6, 7, 8, "x"), (2, "ONE line that is long enough \nrest of it", 5, 6, 7, 8, "y"), (3, long, 1, 2, 3, 4, "z"), (4, long + "!", 1, 2, 3, 4, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cell int, place int, may int, gone_id int, gone_lines string")
    out = {r.doc_id: tuple(r) for r in line_dedup.dedup_lines(df).collect()}
    assert line_dedup.dedup_lines(df).columns == df.columns
    assert out == {1: rows[0], 2: (2, "rest of it", 5, 6, 7, 8, "y"), 3: rows[2]}


def plain_pack(items, capacity):
    bins, out = [], {}
    for i, (size, source, cluster) in items:
        fit = [(capacity - b["n"], k) for k, b in enumerate(bins) if capacity - b["n"] >= size and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"n": 0, "s": set(), "c": set()})
        bins[k]["n"] += size
        bins[k]["s"].add(source), bins[k]["c"].add(cluster)
        out[i] = k
    return out


def test_packing_takes_the_tightest_compatible_bin(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice(["hot", "hot", "b", "c", None, *map(str, range(70))]), rnd.randint(1, 100), rnd.choice([None, 1, 2, *range(10, 60)])) for i in range(400)]
    got = packing.pack_shard([r[0] for r in rows], [r[2] for r in rows], [r[1] for r in rows], [r[3] for r in rows], 101)
    order = sorted(rows, key=lambda r: (-r[2], True, r[0], r[3] or 0, str(r[1])))
    assert {d: b for b, d, *_ in got} == plain_pack([(r[0], (r[2], r[1], r[3])) for r in order], 101)
    odd = spark.createDataFrame([(1, "s", 250, 5), (2, "s", 0, 5), (3, None, None, None), (3, None, 7, None), (None, "s", 7, 5)], "doc_id long, source string, n_tokens long, cluster long")
    out = packing.pack(odd, capacity=100).collect()
    assert sum(r.n_tokens for r in out) == 264 and sum(r.bin_id is None for r in out) == 2
    assert sorted((r.piece, r.n_tokens) for r in out if r.doc_id == 1) == [(0, 100), (1, 100), (2, 50)]
    assert packing.pack(odd.limit(0)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).astype("float32") * rng.uniform(0.2, 3, size=(600, 1)).astype("float32")
    x[300:500] = x[300]  # a third of all rows are one vector
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(600, None, 0), (601, [0.0] * 8, 0), (602, [float("nan")] * 8, 0), (603, [None] * 8, 0), (None, [1.0] * 8, 0), (604, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    d = x.astype("float64")
    for factor, least in ((1.0, 1.0), (0.6, 0.9)):
        out = nearest.nearest_neighbours(df, df.where("vec_id % 20 = 0"), k=20, factor=factor, shard_rows=150, query_rows=10).collect()
        got, scores = {}, {}
        for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append(r.vec_id)
            scores.setdefault(r.query_id, []).append(r.score)
        hits = total = 0
        for q in range(0, 600, 20):
            s = np.einsum("j,ij->i", d[q], d)
            want = [int(i) for i in np.lexsort((np.arange(600), -np.round(s, 9))) if i != q][:20]
            exact = [float(nearest.inner(d[q][None], d[i][None])[0]) for i in got[q]]
            assert exact == scores[q] and exact == sorted(exact, reverse=True)
            hits, total = hits + len(set(want) & set(got[q])), total + 20
        assert len(got) == 30 and hits >= least * total
    assert nearest.nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


def test_trees_of_several_levels_prune_and_keep_ties():
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(40, 3)) * 5)[rng.integers(40, size=2000)] + rng.normal(size=(2000, 3)) * 0.05
    q = x[::40]
    want = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :10]
    recall = {}
    for factor in (1.0, 0.6):
        got, _ = nearest.VantagePointTree(x, leaf=8).search(q, 10, factor)
        recall[factor] = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got, want, strict=True)])
    assert recall[1.0] == 1.0 and recall[0.6] < 0.5  # 0.218 as measured: the smaller factor loses neighbours here
    tied = np.array([[1.0, y] for y in rng.permutation(2000)])
    for leaf in (8, 4096):
        assert set(nearest.VantagePointTree(tied, leaf=leaf).search(np.array([[1.0, 0.0]]), 10)[0][0]) == set(range(10))


def test_ties_go_to_the_smaller_ids(spark):
    """One-hot vectors: all scores but a vector's own are 0."""
    ids = [0, *range(937, 1000)]
    df = spark.createDataFrame([(v, [float(i == k) for i in range(64)]) for k, v in enumerate(ids)], "vec_id long, embedding array<float>")
    for shard in (8192, 10):
        got = nearest.nearest_neighbours(df, df.where("vec_id = 0"), k=20, shard_rows=shard).orderBy("rank").collect()
        assert [r.vec_id for r in got] == list(range(937, 957)) and {r.score for r in got} == {0.0}


def test_shards_that_are_out_of_reach_get_no_query(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 3)) * 20
    x = centres[rng.integers(8, size=1500)] + rng.normal(size=(1500, 3)) * 0.01
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 20 = 0")
    got = {}
    for r in sorted(nearest.nearest_neighbours(df, queries, k=5, shard_rows=200).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, 1500, 20):
        s = nearest.inner(np.broadcast_to(x[q], x.shape), x)
        assert got[q] == [int(i) for i in np.lexsort((np.arange(1500), -s)) if i != q][:5]
    top = float((x * x).sum(axis=1).max())
    tree = nearest.TopTree(x, 8, top)
    leaf, away = tree.route(nearest.augmented(x, top))
    bounds = {int(n): (away[leaf == n].min(axis=0), away[leaf == n].max(axis=0)) for n in np.unique(leaf)}
    aug = np.hstack([x[::20], np.zeros((75, 1))])
    known, gap = tree.gaps(aug, bounds)
    d2 = (x[::20] ** 2).sum(axis=1)[:, None] + top - 2 * x[::20] @ x.T
    for c, n in enumerate(known):
        assert (gap[:, c] <= np.sqrt(np.maximum(d2[:, leaf == n], 0)).min(axis=1) + 1e-6).all()
    kth = np.sqrt(np.maximum(np.sort(d2, axis=1)[:, 5], 0))
    assert (gap > kth[:, None] + 1e-9).mean() > 0.2  # shards that no query has to visit


def test_nearest_is_exact_by_default():
    assert inspect.signature(nearest.nearest_neighbours).parameters["factor"].default == 1.0


def plain_ftrl(rows, rounds=1):
    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= toxicity.L1 else -(z[i] - np.sign(z[i]) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    for _ in range(rounds):
        for features, label in rows:
            w = {i: weight(i) for i in [*features, "bias"]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in w:
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (n[i] ** 0.5 - before**0.5) / toxicity.ALPHA * w[i]
    return {i: weight(i) for i in z}


def test_ftrl_is_the_plain_algorithm():
    rnd = random.Random(3)
    rows = [(sorted(rnd.sample(range(20), rnd.randint(0, 6))), rnd.randint(0, 1)) for _ in range(200)]
    z, n = np.zeros(21), np.zeros(21)
    toxicity.learn(z, n, [(np.array(x, np.int64), y) for x, y in rows])
    got, want = toxicity.weights_of(z, n), plain_ftrl(rows)
    assert any(want.values()) and all(abs(got[20 if i == "bias" else i] - w) < 1e-9 for i, w in want.items())


def plain_descent(rows, y, r, seed):
    w, bias, alpha, rng = {}, 0.0, [0.0] * len(rows), np.random.default_rng(seed)
    for _ in range(quality.EPOCHS):
        for i in rng.permutation(len(rows)):
            norm = sum(r[f] ** 2 for f in rows[i]) + 1
            g = y[i] * (sum(w.get(f, 0.0) * r[f] for f in rows[i]) + bias) - 1
            new = min(max(alpha[i] - g / norm, 0.0), quality.COST)
            for f in rows[i]:
                w[f] = w.get(f, 0.0) + (new - alpha[i]) * y[i] * r[f]
            bias += (new - alpha[i]) * y[i]
            alpha[i] = new
    return w, bias


def test_dual_descent_is_the_plain_algorithm():
    rnd = random.Random(4)
    rows = [sorted(rnd.sample(range(15), rnd.randint(0, 5))) for _ in range(60)]
    y, r = [rnd.choice([-1.0, 1.0]) for _ in rows], np.array([rnd.uniform(-2, 2) for _ in range(15)])
    got = quality.dual_descent([np.array(x, np.int64) for x in rows], np.array(y), r, 5)
    w, bias = plain_descent(rows, y, r, 5)
    assert abs(got[-1] - bias) < 1e-9 and all(abs(got[f] - v) < 1e-9 for f, v in w.items())


def test_one_shard_fits_as_the_plain_algorithms_do(spark):
    rnd = random.Random(7)
    docs = [(i, " ".join(rnd.choice("good fine bad worse plain words here".split()) for _ in range(8))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    again = df.union(df.where("doc_id % 3 = 0"))  # repeated rows train once
    lb = spark.createDataFrame([(i, int("good" in t), int("worse" in t)) for i, t in docs], "doc_id long, quality int, toxic int")

    def rows(label, features, bits):
        out = linear.training_rows(df, linear.labelled_sample(lb, label, 8192), features, bits, 1).orderBy("doc_id").collect()
        return [sorted(r.features) for r in out], [r.label for r in out]

    x, y = rows("quality", quality.shape_features, quality.BITS)
    n, up = {}, {}
    for features, label in zip(x, y, strict=True):
        for f in features:
            n[f], up[f] = n.get(f, 0) + 1, up.get(f, 0) + label
    kept = {f for f in n if n[f] >= 5}
    p, q = sum(1 + up[f] for f in kept), sum(1 + n[f] - up[f] for f in kept)
    r = {f: np.log((1 + up[f]) / p / ((1 + n[f] - up[f]) / q)) for f in kept}
    w, bias = plain_descent([[f for f in features if r.get(f)] for features in x], [1.0 if label else -1.0 for label in y], r, 0)
    got, got_bias, _, _ = quality.fit(again, lb, shards=1)
    assert abs(got_bias - bias) < 1e-9 and np.count_nonzero(got) == sum(v != 0 for v in w.values()) and all(abs(got[f] - v * r[f]) < 1e-9 for f, v in w.items())

    x, y = rows("toxic", toxicity.word_features, toxicity.BITS)
    n = {}
    for features in x:
        for f in features:
            n[f] = n.get(f, 0) + 1
    want = plain_ftrl([([f for f in features if n[f] >= 4], label) for features, label in zip(x, y, strict=True)], rounds=4)
    got = toxicity.fit(again, lb, shards=1)
    assert any(want.values()) and all(abs(got[-1 if i == "bias" else i] - v) < 1e-9 for i, v in want.items())


def test_rounds_of_training_shuffle_no_features(spark, monkeypatch):
    rnd = random.Random(8)
    df = spark.createDataFrame([(i, " ".join(rnd.choice("good bad worse plain".split()) for _ in range(9))) for i in range(80)], "doc_id long, text string")
    lb = df.selectExpr("doc_id", "int(contains(text, 'worse')) as toxic")
    kind, plans = type(df), []
    collected = kind.toPandas
    monkeypatch.setattr(kind, "toPandas", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collected(self))
    assert np.count_nonzero(toxicity.fit(df, lb, rounds=3))
    # counts and rounds shuffle sums by feature only
    assert len(plans) == 4 and all(p.count("Exchange hashpartitioning(") == 1 and "shard" not in p.split("Exchange hashpartitioning(")[1].split(")")[0] for p in plans)


def test_classifiers_on_odd_rows(spark):
    long = " ".join(f"word{k % 977}" for k in range(80_000))
    docs = [(1, "a b c"), (1, "a b c"), (2, long), (3, None), (4, ""), (None, "a b c")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"predicted": F.lit("x"), "label": F.lit("y"), "features": F.lit("z")})
    lb = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 5)], "doc_id long, quality int, toxic int")
    for f in (quality.score_quality, toxicity.score_toxicity):
        out = f(df, lb)
        rows = out.collect()
        assert len(rows) == 6 and out.columns == ["doc_id", "text", "label", "features", "score", "predicted"] or set(out.columns) == {"doc_id", "text", "label", "features", "score", "predicted"}
        assert len({r.score for r in rows if r.text == "a b c"}) == 1 and len({r.score for r in rows if not r.text}) == 1


def test_classifiers(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 8)))
    docs, labels = [(-1, None), (-2, "")], [(None, 1, 1), (5, None, None)]
    for i in range(500):
        w = [word() for _ in range(30)]
        bad, toxic = i % 3 == 0, i % 4 == 0
        if toxic:
            w[rnd.randrange(30)] = rnd.choice(["scum", "scummy", "trash", "trashes"])
        docs.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    lb = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for f, k in ((quality.score_quality, 1), (toxicity.score_toxicity, 2)):
        rows = f(df, lb).withColumn("out", linear.held_out(F.col("doc_id"))).collect()
        assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
        held = [(r.predicted, labels[r.doc_id + 2][k]) for r in rows if r.out and r.doc_id >= 0]
        assert sum(a == b for a, b in held) >= 0.93 * len(held)
        assert f(df.limit(0), lb).count() == 0
        assert {r["score"] for r in f(df, lb.limit(0)).collect()} == {0.5}

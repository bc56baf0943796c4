"""The pipeline's stages keep the columns, and each stage's decision takes effect."""

import random

import corpus_pipeline as cp


def test_stages(spark, tmp_path):
    rnd = random.Random(8)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    rows = [(i, text(60) + "\n" + text(60), "en", f"s{i % 5}", 0) for i in range(60)]
    shared, leak = text(60), text(30)
    rows += [(100 + i, text(80) + "\n" + shared, "en", "s1", 0) for i in range(4)]
    rows += [(200, rows[3][1], "en", "s2", 0), (201, text(90) + " " + leak + " " + text(90), "en", "s3", 0), (202, None, "en", None, 0), (203, "", None, "s", None)]
    rows += [(300 + i, " ".join(x.upper() + "!!" for x in text(50).split()), "en", "s0", 0) for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 300), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, kept[-1], str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/out{k}"))
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in kept]
    assert not {300 + i for i in range(25)} & ids[1] and set(range(60)) <= ids[1]
    assert 200 not in ids[2] and set(range(60)) <= ids[2]
    assert sum(shared in (r.text or "") for r in kept[2].collect()) == 1
    after = {r.doc_id: r.text for r in kept[4].collect()}
    assert 201 in after and leak not in after[201] and set(range(60)) <= set(after)
    assert ids[5] == set(after)
    assert cp.run(spark, str(tmp_path)).count() == kept[5].count()


def test_near_copies_at_five_words_and_four_fifths(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    texts = []
    for size, added in ((100, 20), (45, 0), (100, 30), (90, 15), (60, 0)):  # copies with a block added, or with one word changed
        base = [word() for _ in range(size)]
        other = base + [word() for _ in range(added)]
        if not added:
            other[size // 2] = word()
        texts += [base, other]
    family = [word() for _ in range(120)]
    for _ in range(60):  # a large region, on either side of the limit
        w = list(family)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = word()
        texts.append(w + [word() for _ in range(rnd.randint(0, 15))])

    def linked(i, j, n, percent):
        a, b = ({tuple(t[k : k + n]) for k in range(len(t) - n + 1)} for t in (texts[i], texts[j]))
        return 100 * len(a & b) >= percent * len(a | b)

    def tops(n, percent):
        top = list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                if top[i] != top[j] and linked(i, j, n, percent):
                    top = [min(top[i], top[j]) if x in (top[i], top[j]) else x for x in top]
        return {i for i in range(len(texts)) if top[i] == i}

    want = tops(5, 80)
    assert want != tops(3, 85)
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.near_copies(spark, docs, "").collect()} == want


def test_near_copies_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b c d e f g", "en", "t", 1), (1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, "a B c d e f g", "en", "s", 1)]
    rows += [(3, None, "en", None, None)] * 2 + [(None, "k l m", "en", "s", 1)] * 2 + [(4, "", None, None, 0), (5, "p q r s t u", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(tuple, cp.near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([rows[1], rows[4], rows[6], rows[7], rows[8], rows[9]], key=str)


def test_stages_keep_columns_of_any_names_and_empty_tables(spark, tmp_path):
    names = ["cell", "place", "may", "gone_id", "gone_lines", "score", "predicted", "count", "row", "column_0", "n_words"]
    texts = ["some words of a text that is long enough\nand a second line of it", "some words of a text that is long enough\nsomething else is said here", None, "", "one two three four five six seven"]
    rows = [(i, t, "en", "s", 0, *range(len(names))) for i, t in enumerate([*texts, texts[4]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this is anywhere")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        for r in out.collect():
            assert tuple(r)[5:] == tuple(range(len(names)))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert cp.packed_bins(spark, docs.limit(0), str(tmp_path)).count() == 0

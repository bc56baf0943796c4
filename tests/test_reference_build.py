"""Literal cases and brute force: formulas, headings, folds, neighbours, the breaker, generation, edits."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import headings as H
from sparkloom.functions import maths as M
from sparkloom.functions import text as T
from sparkloom.operators import chunking, curation, generation, jobs, reporting, semantic


def texts(spark, rows):
    return spark.createDataFrame([(i, "s", t) for i, t in enumerate(rows)], "doc_id long, source string, text string")


def test_formulas(spark):
    rows = ["sea $a^2$ y $$b\n= 2$$ fin", "∑ x = 1", "prosa sin nada.", "f(x) = x^2 + 2\n", "", None]
    rows += ["a $ b \\(c$d\\) e$ f", "\\[x\n$y$\\] z", "$$a$b$$ $c$"]
    lines = M.with_lines(texts(spark, rows).where("text is not null"), "text", "m")
    got = {r.doc_id: r for r in lines.select("doc_id", M.formulas(F.col("m")).alias("n"), M.mark(F.col("m")).alias("t")).collect()}
    assert [got[i].n for i in (0, 1, 2, 3, 4)] == [2, 1, 0, 1, 0]
    assert [got[i].t for i in (0, 1, 2, 3, 4)] == [rows[0], "$$ ∑ x = 1 $$", rows[2], "$$ f(x) = x^2 + 2 $$", ""]
    # kinds come one after the other: the round brackets first, then dollars that may enclose them
    assert [(got[i].n, got[i].t) for i in (6, 7, 8)] == [(2, rows[6]), (1, rows[7]), (2, rows[8])]


@pytest.mark.parametrize("line, level, title", [
    ("Capítulo 3: El viaje", 1, "El viaje"), ("IV. Resultados", 1, "Resultados"), ("1. Inicio", 3, "Inicio"), ("1.2 Método", 3, "Método"), ("## Notas ", 2, "Notas"), ("#### Hondo", 3, "Hondo"),
    ("L'ÉTÉ FINAL", 2, "L'Été Final"), ("Resumen breve", 2, "Resumen breve"), ("Esta es una frase", 0, None), ("Con punto final.", 0, None), ("", 0, None),
])
def test_heading_levels(spark, line, level, title):
    x = T.strip(F.lit(line))
    row = spark.range(1).select(H.level(x).alias("level"), H.title(x).alias("title")).first()
    assert row.level == level
    assert title is None or row.title == title


def test_sections_and_tree(spark):
    docs = texts(spark, ["Intro Uno\nhola mundo de aqui.\n\nFin Dos\nadios.", "sin nada.", "", None])
    rows = semantic.sections(docs).collect()
    assert [(r.doc_id, r.heading, r.text) for r in rows] == [(0, "Intro Uno", "hola mundo de aqui."), (0, "Fin Dos", "adios."), (1, "Documento", "sin nada.")]
    tree = {r.doc_id: r.nodes for r in semantic.tree(texts(spark, ["perdido, si.\nCapítulo 1 Uno\na.\n1. Hondo\nb.\n# Nuevo\nc.", "solo."])).collect()}
    assert [(n.level, n.heading, n.text) for n in tree[0]] == [(1, "Uno", "a."), (2, "Sección", "b."), (3, "Hondo", ""), (1, "Nuevo", "c.")]
    assert [(n.heading, n.text) for n in tree[1]] == [("Documento", "solo.")]
    pages = "## Uno, dos.\na.\n.\n.\n.\n1. Hondo\nb.\n.\n.\n.\n.\n.\n.\n.\n.\n# Fin, si.\nc."
    got = [(n.level, n.heading, n.page_start, n.page_end) for n in semantic.tree(texts(spark, [pages])).first().nodes]
    # the section ends where its subsection begins, the implied chapter where the section ended before that
    assert got == [(1, "Contenido", 1, 3), (2, "Uno, dos.", 1, 2), (3, "Hondo", 2, 2), (1, "Fin, si.", 4, 4)]


def merged(sizes, least):
    groups = []
    for i, n in enumerate(sizes):
        if groups and sum(sizes[j] for j in groups[-1]) < least:
            groups[-1].append(i)
        else:
            groups.append([i])
    if len(groups) > 1 and sum(sizes[j] for j in groups[-1]) < least:
        last = groups.pop()
        groups[-1] += last
    return groups


def test_merge_is_the_loop(spark):
    rng = random.Random(5)
    docs = [[rng.randint(0, 9) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    df = texts(spark, ["\n".join(f"# h{i}\n" + "x, " * n for i, n in enumerate(d)) for d in docs])
    for r in semantic.merged_sections(semantic.chapters(semantic.tree(df)), 10).select("doc_id", "merged").collect():
        want = [" / ".join(f"h{i}" for i in g) for g in merged(docs[r.doc_id], 10)]
        assert [s.heading for s in r.merged] == want


def test_chunks_hold_all_words(spark):
    rng = random.Random(6)
    docs = [" ".join(f"w{rng.randint(0, 99)}" + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(1, 300))) for _ in range(30)]
    rows = semantic.semantic_chunks(texts(spark, docs), 40, 0).orderBy("doc_id", "chunk_ord").collect()
    for i, text in enumerate(docs):
        assert " ".join(" ".join(r.text for r in rows if r.doc_id == i).split()) == text
    first, second = semantic.semantic_chunks(texts(spark, ["a b c d e"]), 3, 2).orderBy("chunk_ord").collect()
    assert (first.text, first.heading) == ("a b c", "Documento (Parte 1)")
    assert second.text == semantic.CONTINUED + "b c" + semantic.RULE + "d e"
    assert semantic.semantic_chunks(texts(spark, []), 3, 2).count() == 0


def batches(rows, budget):
    out, used, no = {}, set(), 0
    for doc, chunk, a, b in rows:
        pages = {(doc, p) for p in range(a, b + 1)}
        if out and used and len(used | pages) > budget:
            no, used = no + 1, set()
        out[chunk] = no
        used |= pages
    return out


@pytest.mark.parametrize("blocks", [1, 4, 1024])
def test_page_batches_are_the_loop(spark, blocks):
    schema = "split string, doc_id long, chunk_id string, chunk_ord long, page_start int, page_end int"
    got = chunking.page_batches(spark.createDataFrame([("t", 1, "c1", 0, 1, 50), ("t", 1, "c2", 1, 51, 100), ("t", 2, "c3", 0, 101, 150)], schema), 100)
    assert {r.chunk_id: r.batch_no for r in got.collect()} == {"c1": 0, "c2": 0, "c3": 1}
    rng, rows = random.Random(3), []
    for d in range(60):
        at = 1
        for k in range(rng.randint(1, 5)):
            end = at + rng.choice([0, 1, 2, 3, 30])
            rows.append((d, f"{d}-{k}", at, end))
            at = end + rng.choice([0, 1, 1])
    df = spark.createDataFrame([(s, d, s + c, int(c.split("-")[1]), a, b) for s in "te" for d, c, a, b in rows], schema)
    want = batches(rows, 12)
    assert {r.chunk_id: r.batch_no for r in chunking.page_batches(df, 12, blocks=blocks).collect()} == {s + c: n for s in "te" for c, n in want.items()}
    assert chunking.page_batches(df.limit(0), 12).count() == 0


def test_neighbors_are_the_loop(spark):
    rng = random.Random(7)
    docs = {d: [" ".join(rng.choice("alfa beta gama delta eps yo tu".split()) for _ in range(2)) for _ in range(rng.randint(1, 7))] for d in range(40)}
    rows = [(d, f"{d}-{i}", i, t) for d, ts in docs.items() for i, t in enumerate(ts)]
    got = {r.chunk_id: r.neighbors for r in chunking.lexical_neighbors(spark.createDataFrame(rows, "doc_id long, chunk_id string, chunk_ord long, text string")).collect()}
    words = lambda t: {x for x in t.split() if len(x) > 2}
    for d, ts in docs.items():
        for i, t in enumerate(ts):
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(ts)]
            near += [j for j in range(len(ts)) if j != i and j not in near and words(t) & words(ts[j])]
            assert got[f"{d}-{i}"] == [f"{d}-{j}" for j in near[:2]]


def test_breaker(spark):
    def states(calls):
        df = spark.createDataFrame([("b", i, float(at), bad) for i, (at, bad) in enumerate(calls)], "name string, seq long, at double, failed boolean")
        return [(r.state, r.refused) for r in jobs.breaker_states(df).orderBy("seq").collect()]

    down = [(t, True) for t in range(5)]
    assert states(down) == [("closed", False)] * 4 + [("open", False)]
    assert states([*down, (10, False), (40, False), (41, False)])[5:] == [("open", True), ("half_open", False), ("closed", False)]
    assert states([*down, (40, False), (41, True)])[5:] == [("half_open", False), ("open", False)]
    assert states([(0, False)] * 20) == [("closed", False)] * 20


def test_judge_scores(spark):
    ok = '{"relevance": 1, "groundedness": "0.9", "format": 1, "difficulty": 0, "overall": 0.8, "rationale": "r"}'
    rows = generation.judge_scores(spark.createDataFrame([(1, ok), (2, "no"), (3, ok.replace("0.8", '"x"')), (4, None)], "i long, response string")).orderBy("i").collect()
    assert [(r.groundedness, r.overall, r.rationale) for r in rows] == [(0.9, 0.8, "r")] + [(0.0, 0.0, generation.NO_SCORE)] * 3


def test_generation_keeps_the_last_answer(spark):
    class Stubborn:
        def answer(self, system, user, session):
            return {"question": " q ", "answer": "", "question_type": "fact", "is_answerable": False, "evidence": ["FRAGMENTO 1", " e1 "]}

    chunks = spark.createDataFrame([("c1", 1, "", 1, 2, "uno dos", []), ("c2", 2, "", 3, 3, "tres", ["c1"])], "chunk_id string, doc_id long, heading string, page_start int, page_end int, text string, neighbors array<string>").withColumn("chunk_ord", F.lit(0))
    targets = spark.createDataFrame([("b", "extractive", 0, "c1"), ("b", "unanswerable", 0, "c1"), ("b", "multi_chunk", 0, "c1"), ("b", "multi_chunk", 1, "c2")], "batch string, kind string, pick long, chunk_id string")
    about = generation.summaries(chunks.withColumn("batch", F.lit("b")))
    asked = generation.prompts(generation.contexts(targets, chunks), about)
    got = {(r.kind, r.pick): r for r in generation.examples_of(generation.generate(asked, Stubborn(), 2), asked).collect()}
    assert (got["extractive", 0].attempts, got["extractive", 0].matches, got["extractive", 0].answer) == (1, True, T.REFUSAL)
    assert (got["unanswerable", 0].attempts, got["unanswerable", 0].matches, got["unanswerable", 0].evidence) == (2, False, ["FRAGMENTO 1", " e1 "])
    assert got["multi_chunk", 0].chunk_ids == ["c1"]
    assert (got["multi_chunk", 1].chunk_ids, got["multi_chunk", 1].page_start, got["multi_chunk", 1].page_end) == (["c2", "c1"], 3, 2)


def test_edits(spark):
    rows = [(1, "a", "q1", None), (2, "a", "q2", "duplicate"), (3, "b", "q3", "low_overall")]
    df = spark.createDataFrame(rows, "example_ord long, example_id string, question string, reason string").withColumn("split", F.lit("train"))
    ids = spark.createDataFrame([("a",), ("b",), ("z",)], "example_id string")
    assert [r.example_ord for r in curation.delete(df, ids).collect()] == [2]
    patched = curation.patch(df, spark.createDataFrame([("a", "new", "x")], "example_id string, question string, reason string"))
    assert sorted((r.example_ord, r.question, r.reason) for r in patched.collect()) == [(1, "new", None), (2, "new", "duplicate"), (3, "q3", "low_overall")]


def test_guard_and_phases(spark):
    curated = spark.createDataFrame([("train", None)], "split string, reason string")
    mode = lambda rows: reporting.dataset_mode(spark.createDataFrame(rows, "doc_id long, split string"))
    two, one = mode([(1, "train"), (2, "eval")]), mode([(1, "train")])
    error = lambda *a, **k: reporting.export_guard(*a, **k).first().error
    assert error(curated, two) == reporting.NO_EVAL
    assert error(curated, one) is None
    assert error(curated, two, allow_partial=True) is None
    assert error(curated.limit(0), one) == reporting.NO_TRAIN
    assert jobs.first_phase("judge", only_eval=True) == "judge_eval"
    with pytest.raises(ValueError):
        jobs.first_phase("nothing")


def test_text_measures(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.image_tokens(F.lit(513), F.lit(512))) == 85 + 340
    assert one(T.image_tokens(F.lit(0), F.lit(512))) == 0
    assert one(T.truncated(F.lit("abc  defg"), 6)) == "abc…"
    assert [one(T.language_name(F.lit(x))) for x in ("ES", "xx", "", None)] == ["Spanish", "xx", "the source language", "the source language"]
    assert one(T.language(F.lit("el perro y los gatos que una vez vinieron con sus crias"))) == "es"
    assert one(T.language(F.lit("el perro"))) == "es"
    assert one(T.language(F.lit("x" * 50), detector=lambda t: "xx")) == "xx" and one(T.language(F.lit("short"), "en", detector=lambda t: "xx")) == "en"
    assert [one(T.token_count(F.lit(t).cast("string"), len)) for t in ("abc d", "", None)] == [5, 0, 0]

"""Literal cases: files, exports, settings, chunks, edits, the judge, pages, streams."""

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkloom import config
from sparkloom.functions import text as T
from sparkloom.operators import chunking, curation, dashboard, generation, ingest, jobs, planning, ranking, reporting
from sparkloom.sources import files
from sparkloom.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def names(df):
    return [Path(r.path).name for r in df.collect()]


def test_discover(spark, tmp_path):
    for name in ("b.pdf", "a.pdf", "C.PDF", "sub/d.pdf", "note.txt", ".work/x.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    folder = str(tmp_path)
    assert names(files.discover(spark, folder, recursive=False)) == ["a.pdf", "b.pdf"]
    assert [n for n in names(files.discover(spark, folder)) if n != "x.pdf"] == ["a.pdf", "b.pdf", "d.pdf"]
    assert names(files.discover(spark, folder, recursive=False, limit=1)) == ["a.pdf"] and names(files.discover(spark, folder, limit=-3)) == []
    assert names(files.discover(spark, f"{folder}/C.PDF")) == ["C.PDF"] and names(files.discover(spark, f"{folder}/note.txt")) == []
    assert files.discover(spark, f"{folder}/none").count() == 0
    assert sorted(r.name for r in files.listing(spark, folder).collect()) == ["C.PDF", "a.pdf", "b.pdf", "d.pdf", "note.txt"]
    wanted = spark.createDataFrame([(0, "b.pdf"), (1, "nothing.pdf"), (2, "a.pdf")], "ord int, name string")
    found = files.discover(spark, folder)
    assert names(files.chosen(found, f"file:{folder}", wanted)) == ["b.pdf", "a.pdf"] and names(files.chosen(found, f"file:{folder}", wanted, 1)) == ["b.pdf"]


def test_link_names(spark):
    paths = ["/a/r.pdf", "/b/r.pdf", "/c/r-1.pdf", "/d/r.pdf", "/e/r-1.pdf", "/f/x.tar.gz", "/g/x.tar.gz", "/h/r.txt"]
    got = files.link_names(spark.createDataFrame(list(enumerate(paths)), "ord int, path string")).orderBy("ord").collect()
    assert [r.name for r in got] == ["r.pdf", "r-1.pdf", "r-1-1.pdf", "r-2.pdf", "r-1-2.pdf", "x.tar.gz", "x.tar-1.gz", "r.txt"]


def test_json_and_csv(spark, tmp_path):
    path = str(tmp_path / "m.json")
    assert files.read_json(spark, path) == {}
    files.write_json(spark, {"a": "ñ", "b": [1]}, path)
    assert files.read_json(spark, path) == {"a": "ñ", "b": [1]} and "\\u00f1" in Path(path).read_text()
    df = spark.createDataFrame([(1, [1, 2], 'say "x", y')], "a long, pages array<int>, t string").coalesce(1)
    files.write_csv(df, str(tmp_path / "c"))
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert text == 'a,pages,t\n1,"[1,2]","say ""x"", y"\n'
    files.write_csv(df.limit(0), str(tmp_path / "c"))
    assert "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv")) == ""
    files.write_jsonl(df, str(tmp_path / "j"))
    files.append_jsonl(df, str(tmp_path / "j"))
    assert files.read_jsonl(spark, str(tmp_path / "j"), "a long").count() == 2


def test_run_paths():
    assert files.run_paths("/p").exports == "/p/artifacts/exports"
    paths = files.run_paths("/p", "/in/one.pdf", "j1")
    assert (paths.run, paths.work, paths.exports) == ("/in/extraccion_dataset/j1", "/in/extraccion_dataset/j1/.work/j1", "/in/extraccion_dataset/j1")


ROW = "example_ord long, example_id string, doc_id long, split string, question string, answer string, question_type string, is_answerable boolean, overall double, groundedness double, reason string, chunk_ids array<string>, page_start long, page_end long"


def example(k, split="train", reason=None, overall=0.9, name=None):
    return (k, name or f"e{k}", k, split, f"q{k}", f"a{k}", "fact", True, overall, overall, reason, ["c"], 1, 2)


def test_export(spark, tmp_path):
    mode = lambda rows: reporting.dataset_mode(spark.createDataFrame(rows, "doc_id long, split string"))
    rows = spark.createDataFrame([example(1), example(2, "eval"), example(3, reason="low_overall"), example(4)], ROW)
    folder = str(tmp_path)
    both = mode([(1, "train"), (2, "eval")])
    assert reporting.export(rows, both, folder, 3) == {"train": 2, "eval": 1, "review": 3}
    record = json.loads(next((tmp_path / "train.jsonl").glob("*.json")).read_text().splitlines()[0])
    assert [m["role"] for m in record["messages"]] == ["system", "user", "assistant"] and list(record["metadata"]) == list(curation.METADATA)
    assert record["metadata"]["page_range"] == [1, 2] and record["metadata"]["question_type"] == "extractive" and record["metadata"]["language"] is None
    assert reporting.export(rows, mode([(1, "train")]), folder)["eval"] == 0 and not (tmp_path / "eval.jsonl").exists()
    with pytest.raises(RuntimeError, match="eval no vacio"):
        reporting.export(rows.where("split = 'train'"), both, folder)
    assert reporting.reexport(rows.where("split = 'eval'"), folder) == {"train": 0, "eval": 1, "review": 0}
    assert not (tmp_path / "train.jsonl").exists() and not (tmp_path / "review_sample.csv").exists()


def test_settings(spark, tmp_path):
    plain = config.resolved()
    assert plain["providers"]["active"] == "fireworks" and {"fireworks", "openai", "zai", "groq", "openrouter", "xai"} == set(plain["providers"]["profiles"])
    assert plain["generation"]["page_batch_size"] == 100 and plain["generation"]["batch_pause_seconds"] == 2.0 and config.workers(plain) == (2, 1)
    assert plain["chunking"]["max_pages_per_chunk"] == 25 and plain["parsing"]["docling_max_pages"] == 100 and plain["parsing"]["docling_max_ram_mb"] == 3072 and plain["export"]["allow_partial_export"] is False
    old = config.resolved({
        "fireworks": {"api_key_env": "KEY", "base_url": "u", "model": "m", "max_tokens": 111, "temperature": 0.3, "concurrency": 2},
        "parsing": {"primary_parser": "pymupdf", "docling_max_pages": None}, "chunking": {"strategy": "headings_first", "target_tokens": 256, "overlap": 32},
        "generation": {"prompt_version": "v1", "backend": "sync_pool", "retries": 3, "mix": {"extractive": 1.0}, "refusal_text": "nope", "max_generation_attempts_per_target": 2},
        "filters": {"groundedness_threshold": 0.7, "overall_threshold": 0.7}, "review": {"sample_size": 10}, "nothing": 1,
    })
    assert old["providers"]["profiles"]["fireworks"] == {"api_key_env": "KEY", "base_url": "u", "model": "m", "max_tokens": 111, "temperature": 0.3, "concurrency": 2, "extra_headers": {}}
    assert config.provider(old)["model"] == "m" and config.provider(old, "groq")["max_tokens"] == 2048 and old["generation"]["mix"] == {"extractive": 1.0} and "nothing" not in old
    assert old["parsing"]["docling_max_pages"] is None and old["parsing"]["fallback_parser"] == "pymupdf" and old["review"]["sample_size"] == 10
    with pytest.raises(KeyError):
        config.provider(old, "other")
    work = lambda **own: config.workers(config.resolved({"generation": own}))
    assert work(resource_profile="balanced") == (2, 1) and work(resource_profile="throughput", generation_workers=3, judge_workers=2) == (3, 2)
    assert work(resource_profile="throughput", generation_workers=None, judge_workers=None) == (6, 3) and work(resource_profile="balanced", generation_workers=None, judge_workers=0) == (4, 2)
    least = lambda **own: config.thresholds(config.resolved({"filters": own}))
    assert least(preset="strict") == (0.85, 0.85) and least(preset="strict", groundedness_threshold=0.8, overall_threshold=None) == (0.8, 0.85) and least(preset="other") == (0.7, 0.7)
    strict = config.with_quality(config.with_quality(plain, overall=0.1), "strict", groundedness=0.5)
    assert config.thresholds(strict) == (0.5, 0.85) and config.thresholds(plain) == (0.7, 0.7)
    for bad in ({"preset": "none"}, {"overall": 1.5}):
        with pytest.raises(ValueError):
            config.with_quality(plain, **bad)
    for bad in ({"chunking": {"overlap": "many"}}, {"chunking": 3}, {"parsing": {"enable_ocr": 1}}, {"generation": {"retries": 1.5}}):
        with pytest.raises(ValueError):
            config.resolved(bad)
    fast = config.with_parser_mode(plain, "fast")["parsing"]
    assert (fast["primary_parser"], fast["enable_ocr"]) == ("pymupdf", False) and config.with_parser_mode(plain, "other") == plain
    config.save(spark, old, str(tmp_path / "c.json"))
    assert config.load(spark, str(tmp_path / "c.json")) == old


def test_accept_takes_the_last_of_repeated_ids(spark):
    rows = spark.createDataFrame([example(1, reason="r", name="x", overall=None), example(2, reason="s", name="x", overall=None), example(3), example(4, reason="t", name="e3")], ROW).withColumn("rationale", F.lit(None).cast("string"))
    ids = spark.createDataFrame([("x",), ("e3",)], "example_id string")
    got = {r.example_ord: (r.reason, r.overall, r.rationale) for r in curation.accept(rows, ids).collect()}
    assert got == {2: (None, 0.8, "manual override"), 3: (None, 0.9, None), 4: ("t", 0.9, None)}
    got = {r.example_ord: r.reason for r in curation.reject(rows, ids).collect()}
    assert got == {1: "r", 2: "s", 3: "manual_rejection", 4: "t"}
    assert sorted((r.example_id, r.bucket) for r in curation.find(rows, ids).collect()) == [("e3", "accepted"), ("x", "rejected")]
    with pytest.raises(ValueError):
        curation.bulk_edit(rows, ids, "burn")


def test_strip_is_that_of_any_white_space(spark):
    base = (1, True, ["e"], "extractive", "fact ", 0.9, 0.9)
    rows = [(k, *base, q, a) for k, (q, a) in enumerate([("q", "a"), ("\tQ\n", "a\u00a0"), ("q2", "a")])]
    df = spark.createDataFrame(rows, "example_ord long, doc_id long, is_answerable boolean, evidence array<string>, requested_kind string, question_type string, overall double, groundedness double, question string, answer string")
    assert [r.reason for r in curation.curate(df).orderBy("example_ord").collect()] == [None, "duplicate", None]
    assert one(spark, T.question_type(F.lit("\tMulti Hop\n"))) == "multi_chunk"


def test_evidence(spark):
    given = F.array(*map(F.lit, (" a ", "Fragmento 1", "evidencia", "", "fragmentos", "a")))
    assert one(spark, generation.resolved_evidence(given, F.array(F.lit("t "), F.lit("a"), F.lit(" ")), F.lit(True))) == ["a", "fragmentos", "t"]
    assert one(spark, generation.resolved_evidence(given, F.array(F.lit("t")), F.lit(False))) == [" a ", "Fragmento 1", "evidencia", "fragmentos", "a"]


def test_scores_count_images(spark):
    df = spark.createDataFrame([("3 es mayor", True), ("3 es mayor", None)], "text string, requires_multimodal boolean").withColumns({"tokens": F.lit(2500), "n_neighbors": F.lit(2)})
    got = [tuple(r) for r in planning.chunk_scores(df).select(*planning.PLAN_ORDER).collect()]
    assert got == [(4, 6, 5, 3, 5), (4, 5, 4, 3, 4)]


def test_judge_asks_each_open_id_once(spark):
    class Judge(generation.EchoJudge):
        def answer(self, system, user, session):
            if session == "b":
                return {"overall": 1}
            return super().answer(system, user, session)

    ex = spark.createDataFrame([(1, "a", "q", "x zzz", ["x"]), (2, "b", "q", "x", []), (3, "b", "q", "x", []), (4, "c", "q", "x", [])], "example_ord long, example_id string, question string, answer string, evidence array<string>")
    earlier = spark.createDataFrame([("c", k, *[0.1 * k] * 5, "r") for k in (1, 2)], "example_id string, seq long, relevance double, groundedness double, format double, difficulty double, overall double, rationale string")
    got = {r.example_ord: (r.overall, r.rationale) for r in generation.judged(ex, earlier, Judge()).collect()}
    assert got == {1: (0.5, "words in the evidence"), 2: (0.0, generation.NO_SCORE), 3: (0.0, generation.NO_SCORE), 4: (0.2, "r")}


def test_pages_and_extraction(spark, tmp_path):
    long = "palabra " * 20
    rows = [(1, long, long * 2, False), (2, "corto", "leido por OCR", False), (3, "corto", "c", False), (4, "a = b " + long, None, False), (5, long, None, True), (6, None, None, None)]
    got = {r.n: (r.page_text == "leido por OCR", r.ocr_used, r.visual, r.requires_multimodal) for r in ingest.read_pages(spark.createDataFrame(rows, "n int, raw_text string, ocr_text string, has_images boolean")).collect()}
    assert got == {1: (False, False, False, False), 2: (True, True, False, True), 3: (False, False, False, True), 4: (False, False, True, True), 5: (False, False, True, True), 6: (False, False, False, True)}
    one_ = lambda *limits: one(spark, ingest.skip_reason(F.lit(9), F.lit(100), *limits))
    assert [one_(8, 50), one_(9, 101), one_(None, None), one_(8, 101)] == ["docling_max_pages", "docling_max_ram_mb", None, "docling_max_pages"]

    class Picky(ingest.PlainText):
        name = "picky"

        def pages(self, content):
            raise ValueError("no")

    data = spark.createDataFrame([("a", b"x\fy"), ("b", b"\xff")], "path string, content binary")
    got = {r.path: (r.pages, r.parser, r.error and r.error.split(":")[0]) for r in ingest.extracted(data, [Picky(), ingest.PlainText()]).collect()}
    assert got == {"a": (["x", "y"], "plain", None), "b": (None, None, "plain")}


def document(spark, pages, sections=(), text=None):
    schema = "doc_id long, source string, text string, pages array<string>, sections array<struct<section_ord:long,heading:string,page_start:long,page_end:long,text:string>>"
    rows = [(1, "s", "\n".join(pages) if text is None else text, pages, [(k, *s) for k, s in enumerate(sections)])]
    return ingest.with_assets(spark.createDataFrame(rows, schema))


def test_document_chunks(spark):
    # given sections, one of them too long, in word windows
    sections = [("Uno", 1, 1, "a b c d e f g h"), ("Dos", 2, 2, "i j")]
    rows = chunking.document_chunks(document(spark, ["a b c d e f g h", "i j"], sections), 4, 1, chunking.strategy_of("Headings_First ")).orderBy("chunk_ord").collect()
    assert [(r.text, r.heading, r.page_start) for r in rows] == [("a b c d", "Uno", 1), ("d e f g", "Uno", 1), ("g h", "Uno", 1), ("i j", "Dos", 2)]
    assert rows[0].neighbors == [rows[1].chunk_id] and rows[0].chunking_strategy == "headings_first" and rows[0].requires_multimodal and rows[0].page_image_paths == ["pages/1/page-0001.png"]
    # pages over the limit
    pages = [f"pagina {k}" for k in range(1, 6)]
    whole = [("Todo", 1, 5, " ".join(pages)), ("Fin", 5, 5, "fin")]
    rows = chunking.document_chunks(document(spark, pages, whole), 100, 0, max_pages=2).orderBy("chunk_ord").collect()
    assert [(r.page_start, r.page_end) for r in rows if r.split_reason][:3] == [(1, 2), (3, 4), (5, 5)] and rows[0].chunk_id.endswith("-p0001-0002") and rows[0].parent_chunk_id == rows[1].parent_chunk_id
    # too few chunks for the pages, without sections
    rows = chunking.document_chunks(document(spark, [f"pagina {k}" for k in range(40)]), 8192, 200, density=20).orderBy("chunk_ord").collect()
    assert [(r.page_start, r.page_end, r.split_reason) for r in rows] == [(1, 20, "min_chunk_density"), (21, 40, "min_chunk_density")]
    assert (rows[0].coverage_ratio, rows[0].expected_min_chunks, rows[0].low_coverage, rows[0].low_chunk_density_fallback) == (1.0, 2, False, True)
    assert chunking.strategy_of("x") == chunking.strategy_of() == "semantic" and chunking.strategy_of(use_semantic=False) == "headings_first"
    assert chunking.document_chunks(document(spark, ["x"]).limit(0), 8, 2).count() == 0


def test_dashboard(spark):
    rows = spark.createDataFrame([example(k, reason=None if k % 2 else "r") for k in range(1, 8)], ROW).withColumns({"source_doc": F.lit("Informe.pdf"), "job_id": F.concat(F.lit("j"), F.col("doc_id"))})
    assert dashboard.filtered(rows, search="INFORME").count() == 7 and dashboard.filtered(rows, search="zzz").count() == 0
    assert [dashboard.accepted_flag(x) for x in ("YES ", "0", "perhaps", None)] == [True, False, None, None]
    paged = dashboard.page_with_total(rows, 2, 1).orderBy("example_ord").collect()
    assert [(r.example_ord, r.total) for r in paged] == [(2, 7), (3, 7)]
    assert dashboard.page(rows, 900, 0, dashboard.JOB_PAGE).count() == 7
    tags = dashboard.tagged(rows.where("reason is null"), rows.where("reason is not null"))
    assert {(r.accepted, r.reason) for r in tags.collect()} == {(True, None), (False, "r")}
    dim = spark.createDataFrame([(f"j{k}", "2024", k) for k in range(1, 8)], "job_id string, created_at string, ord long")
    assert sorted(r.job_id for r in dashboard.of_latest_jobs(rows, dim, 2).collect()) == ["j6", "j7"]


def test_jobs(spark):
    new, first = jobs.created(spark.createDataFrame([("j", "/in")], "job_id string, source string"))
    assert new.first().status == "queued" and first.first().message == "Job created"
    e = spark.createDataFrame([(1, "j", "queued", 0.0, "m", None), (2, "j", "running", 0.1, None, "s1"), (3, "j", "running", 0.2, None, None)], "event_id long, job_id string, status string, percent double, message string, stats string")
    got = jobs.latest_state(e).first()
    assert (got.percent, got.message, got.stats) == (0.2, None, "s1")
    assert one(spark, jobs.milestone(F.lit("export"), F.lit(None), F.lit(None))) == 0.95 and one(spark, jobs.milestone(F.lit("other"), F.lit(1), F.lit(2))) is None


def test_following_a_job_ends(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = [(k, datetime(2024, 1, 1), k % 2, "view" if k < 5 else "purchase", 1.0, "{}") for k in range(6)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    shown = []
    assert events.follow(spark, str(tmp_path / "in"), "job-1", str(tmp_path / "c1"), lambda df: shown.append(df.count()), 0.01)
    assert shown == [3] and not events.follow(spark, str(tmp_path / "in"), "job-0", str(tmp_path / "c2"), lambda df: None, 0.01, 3)


def test_tables_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, tokens long")
    assert ranking.numbered(none, ["tokens"], ["doc_id"]).count() == 0 and planning.split_manifest(none).count() == 0
    assert [r.split for r in planning.split_manifest(spark.createDataFrame([("a", 5)], "doc_id string, tokens long")).collect()] == ["train"]


def test_ingest_folder(spark, tmp_path):
    (tmp_path / "One Two.txt").write_bytes("Intro Uno\f∑ x = 1\festo es el cuerpo, con palabras de la pagina tres.\f".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff")
    (tmp_path / "z.txt").write_bytes(b"nothing")
    docs, chunks = ingest.ingest_folder(spark, str(tmp_path), [ingest.PlainText()], "*.txt", limit=2)
    got = {r.source_doc: r for r in docs.collect()}
    assert set(got) == {"One Two.txt", "bad.txt"} and got["bad.txt"].error and got["bad.txt"].pages == []
    one_ = got["One Two.txt"]
    assert one_.doc_id.startswith("one-two-") and one_.math_expressions == 1 and one_.pages[1] == "$$ ∑ x = 1 $$" and len(one_.pages) == 4
    assert [(s.heading, s.page_start) for s in one_.sections] == [("Intro Uno", 1)] and one_.language == "es"
    rows = chunks.collect()
    assert len(rows) == 1 and rows[0].page_end == 4 and rows[0].page_count == 4 and rows[0].requires_multimodal and rows[0].neighbors == []


def test_phases_are_marked(spark, tmp_path):
    for phase in ("split", "ingest", "report"):
        jobs.save_phase(spark, str(tmp_path), phase, ["x"], {"n": 1})
    assert jobs.completed_phases(spark, str(tmp_path)) == ["ingest", "split", "report"]
    with pytest.raises(ValueError):
        jobs.save_phase(spark, str(tmp_path), "nothing")

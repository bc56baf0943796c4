"""Literal cases: text, windows, quotas, the rule cascade, JSON lines, the stream."""

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import chunking, curation, planning
from sparkloom.sources import files
from sparkloom.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize_text(spark):
    text = F.lit("Intro Header\ninfor-\n mation   relevante\t\tcon   espacios.\n\nFooter")
    assert one(spark, T.normalize_text(text, F.array(F.lit("Intro Header"), F.lit("Footer")))) == "information relevante con espacios."
    assert one(spark, T.normalize_text(F.lit("razó-\n n b c"))) == "razón b c"


def test_words_and_types(spark):
    assert one(spark, T.word_count(F.lit("uno dos tres cuatro"))) == 4
    assert one(spark, T.word_count(F.lit(None).cast("string"))) == 0
    for raw, kind in (("fact", "extractive"), ("Factoid", "extractive"), ("multi-hop", "multi_chunk"), ("other kind", "other_kind")):
        assert one(spark, T.question_type(F.lit(raw))) == kind


def test_word_windows(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(12)))), (2, ""), (3, None)], "doc_id long, text string")
    rows = chunking.word_windows(docs, 6, 2).orderBy("chunk_ord").collect()
    assert [(r.doc_id, r.chunk_ord, r.n_words) for r in rows] == [(1, 0, 6), (1, 1, 6), (1, 2, 4)]


def test_page_windows(spark):
    paged = spark.createDataFrame([(1, "s", [f"pagina {i}" for i in range(1, 7)])], "doc_id long, source string, pages array<string>")
    rows = chunking.page_windows(paged, 2).orderBy("chunk_ord").collect()
    assert [(r.page_start, r.page_end) for r in rows] == [(1, 2), (3, 4), (5, 6)]
    assert rows[0].text == "pagina 1\n\npagina 2"


def test_split(spark):
    docs = spark.createDataFrame([(1, 200), (2, 40), (3, 20), (4, 20)], "doc_id long, tokens long")
    split = {r.doc_id: r.split for r in planning.split_manifest(docs, 0.25).collect()}
    assert split == {1: "eval", 2: "train", 3: "train", 4: "train"}
    assert planning.split_manifest(docs.where("doc_id = 1")).first().split == "train"
    assert planning.split_manifest(docs.limit(0)).count() == 0


def test_quota(spark):
    got = {r.kind: r.quota for r in planning.kind_quota(spark.createDataFrame([(6,)], "total long")).collect()}
    assert got == {"extractive": 2, "inferential": 1, "unanswerable": 1, "multi_chunk": 1, "format_specific": 1}


def test_duplicate_of_a_rejected_row_is_none(spark):
    row = lambda k, g: (k, 1, "q", "a", True, ["e"], "extractive", "fact", 0.9, g)
    schema = "example_ord long, doc_id long, question string, answer string, is_answerable boolean, evidence array<string>, requested_kind string, question_type string, overall double, groundedness double"
    rows = curation.curate(spark.createDataFrame([row(1, 0.1), row(2, 0.9), row(3, 0.9)], schema)).orderBy("example_ord").collect()
    assert [r.reason for r in rows] == ["low_groundedness", None, "duplicate"]


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    files.write_jsonl(df, str(tmp_path / "t"))
    assert sorted(files.read_jsonl(spark, str(tmp_path / "t"), "a long, b string").collect()) == sorted(df.collect())
    assert files.read_jsonl(spark, str(tmp_path / "none"), "a long").count() == 0


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    rows = [(i, None, i % 2, "view", 1.0, "{}") for i in range(6)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    where = [str(tmp_path / x) for x in ("in", "out", "mark")]
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(where[0])
        events.append_tail(spark, *where, after=1)
    assert sorted(r.event_id for r in spark.read.parquet(where[1]).collect()) == [2, 3, 4, 5]

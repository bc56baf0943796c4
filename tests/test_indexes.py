"""Trigram search, the edit log, token windows, language profiles, running lines."""

import os
import random
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom import registry
from sparkloom.functions import packing
from sparkloom.operators import chunking, curation, dashboard, editlog, language, running, search, semantic
from sparkloom.sources.tables import documents

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")


def test_a_trigram_index_finds_what_a_scan_finds(spark, tmp_path):
    rnd = random.Random(1)
    words = ["alpha", "Beta", "gamma ray", "ÉCOLE", "x", "", "naïve", "日本語テキスト", "alphabet"]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 5))), rnd.choice(words + [None])) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, question string, answer string").repartition(3)
    path = search.write_index(df, "id", ["question", "answer"], str(tmp_path), buckets=16)
    ask = lambda needle: search.search(df, "id", ["question", "answer"], path, needle, buckets=16)
    for needle in ("alpha", "ALPHA b", "alphabet", "école", "ma r", "x", "", "日本語", "本語テ", "zzz", "betagamma", "a", "al", "naïve naïve"):
        assert sorted(r.id for r in ask(needle).collect()) == sorted(r.id for r in dashboard.filtered(df, search=needle).collect() if needle) if needle else ask(needle).count() == 300, needle
    read = search.posted(spark, path, "école", 16)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len({f.split("bucket=")[1].split("/")[0] for f in read.inputFiles()}) <= 16
    folders = {r["f"] for r in read.select(F.regexp_extract(F.input_file_name(), r"bucket=(\d+)", 1).alias("f")).distinct().collect()}
    assert len(folders) <= len(search.needle_grams("école"))


ROW = "example_ord long, example_id string, split string, question string, answer string, evidence array<string>, question_type string, difficulty string, is_answerable boolean, overall double, groundedness double, reason string, rationale string"


def edited(spark):
    rnd = random.Random(4)
    rows = [(k, f"e{rnd.randint(0, 20)}", rnd.choice(["train", "eval"]), "q", f"a{k}", ["x"], "extractive", "easy", True, rnd.choice([None, 0.5]), 0.5, rnd.choice([None, "bad", "worse"]), None) for k in range(90)]
    return spark.createDataFrame(rows, ROW)


def test_a_log_of_edits_is_the_chain_of_edits(spark, tmp_path):
    base, chain = edited(spark), edited(spark)
    log = editlog.EditLog(spark, str(tmp_path / "log"))
    with pytest.raises(FileNotFoundError):
        log.base()
    log.begin(base)
    ids = lambda *n: spark.createDataFrame([(f"e{k}",) for k in n], "example_id string")
    patch = spark.createDataFrame([("e1", "new?", None), ("e7", None, False)], "example_id string, question string, is_answerable boolean")
    steps = [("accept", ids(1, 2, 3), "x"), ("reject", ids(2, 4, 5), "no good"), ("delete", ids(5, 6, 99), "x"), ("patch", patch, "x"), ("accept", ids(4, 8), "x"), ("reject", ids(1), "again"), ("delete", ids(1), "x")]
    plain = {"accept": lambda c, i, r: curation.accept(c, i), "reject": curation.reject, "delete": lambda c, i, r: curation.delete(c, i), "patch": lambda c, i, r: curation.patch(c, i)}
    shown = lambda df: Counter(tuple(map(str, r)) for r in df.select(base.columns).collect())
    for k, (action, which, reason) in enumerate(steps):
        assert log.append(which, action, reason) == k
        chain = spark.createDataFrame(plain[action](chain, which, reason).select(base.columns).collect(), ROW)
        if k in (2, 4, 6):
            assert shown(log.folded()) == shown(chain), action
        if k == 4:
            # a new reader of the same folder goes on, before and after compaction
            log.compact()
            log = editlog.EditLog(spark, str(tmp_path / "log"))
            assert log.log().count() == 0 and shown(log.folded()) == shown(chain)
    assert shown(editlog.EditLog(spark, str(tmp_path / "log")).folded()) == shown(chain) and len(list((tmp_path / "log").glob("base-*"))) == 1
    with pytest.raises(ValueError):
        log.append(ids(1), "other")
    one = log.append(spark.createDataFrame([("e9", "train")], "example_id string, split string"), "reject", "r")
    assert one == len(steps) and {r.split for r in log.folded().where("reason = 'r'").collect()} <= {"train"}


Pieces = partial(chunking.PieceTokens, 3)


def test_windows_by_tokens(spark):
    rnd = random.Random(6)
    texts = [" ".join("w" * rnd.randint(1, 14) for _ in range(rnd.choice([0, 1, 5, 80]))) for _ in range(40)] + [None, " \n", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    count = lambda words: sum(-(-len(w) // 3) for w in words)
    for target, overlap in ((10, 3), (4, 0), (2, 5), (500, 20)):
        got = {}
        for r in chunking.token_windows(df, Pieces, target, overlap).collect():
            got.setdefault(r.doc_id, []).append((r.chunk_ord, r.n_words, r.n_tokens, r.text))
        for d, text in enumerate(texts):
            words, want, i = (text or "").split(), [], 0
            while i < len(words):
                j = i + 1
                while j < len(words) and count(words[i : j + 1]) <= target:
                    j += 1
                want.append((len(want), j - i, count(words[i:j]), " ".join(words[i:j])))
                if j == len(words):
                    break
                i = next((k for k in range(i + 1, j) if count(words[k:j]) <= overlap), j)
            assert sorted(got.get(d, [])) == want, (d, target, overlap)
    sections = spark.createDataFrame([(1, "s", [("H", 1, 2, "aaaa bb\n\nccccccc\n\ndd " + "e " * 9, 15)])], "doc_id long, source string, merged array<struct<heading:string,page_start:int,page_end:int,text:string,tokens:long>>")
    parts = [r.text for r in semantic.split_sections(sections, 4, chunking.token_counter(Pieces)).orderBy("part").collect()]
    assert parts == ["aaaa bb", "ccccccc", "dd " + "e " * 8 + "e"]
    assert packing.token_windows(pa.array([[], None, [3, 6]], pa.list_(pa.int64())), 6, 1).to_pylist() == [[], None, [{"start": 0, "end": 2}]]


@tables
def test_language_profiles_beat_function_words(spark):
    from sparkloom.functions import text as T

    docs = documents(spark, "/root/testdata/sf0.01").where("text is not null and lang is not null")
    rows = language.detected(docs, language.learned(docs)).withColumn("words", T.language(F.col("text"), "en")).where(language.held_out(F.col("doc_id"))).select("lang", "detected", "words").collect()
    share = lambda name: np.mean([r.lang == r[name] for r in rows])
    assert len(rows) > 150 and share("detected") > 0.97 and share("detected") >= share("words")
    none = spark.createDataFrame([], docs.schema)
    odd = spark.createDataFrame([(1, None), (2, "short"), (3, "x" * 100)], "doc_id long, text string")
    assert {r.detected for r in language.detected(odd, language.learned(none), "en").collect()} == {"en"}


def test_sketches_miss_no_frequent_line(spark, monkeypatch):
    rnd = random.Random(9)
    docs = []
    for k in range(120):
        lines = []
        for p in range(4):
            lines += [rnd.choice([f"Report {k} page {p}", f"noise {rnd.random()}"]), *("body " + "".join(rnd.choices("abcdefghijkl", k=8)) for _ in range(3)), rnd.choice(["", "Footer", f"end {rnd.random()}"])]
        docs.append((k, rnd.choice(["s", "t", None]), "\n".join(lines)))
    df = spark.createDataFrame(docs + [(500, "s", None), (501, "u", "")], "doc_id long, source string, text string").repartition(4)
    counts, pages = Counter(), Counter()
    for _, s, t in docs:
        lines = t.split("\n")
        for a in range(0, len(lines), 5):
            full = [x for x in lines[a : a + 5] if x]
            for edge, line in (("head", full[0]), ("foot", full[-1])):
                counts[s, edge, "".join("#" if c.isdigit() else c for c in line)] += 1
                pages[s, edge] += 1
    import re

    plain = Counter()
    for _, s, t in docs:
        lines = t.split("\n")
        for a in range(0, len(lines), 5):
            full = [x for x in lines[a : a + 5] if x]
            plain[s, "head", re.sub("[0-9]+", "#", full[0])] += 1
            plain[s, "foot", re.sub("[0-9]+", "#", full[-1])] += 1
    for share in (0.5, 0.1, 0.02):
        want = {(*k, n, pages[k[:2]]) for k, n in plain.items() if n >= max(3, share * pages[k[:2]])}
        assert {tuple(r) for r in running.running_lines(df, share).collect()} == want and (want or share > 0.4)
    for k in (1, 3, 10):
        parts = [Counter(rnd.choices("aaaabbbcdefgh", k=rnd.randint(1, 80))) for _ in range(9)]
        sketch, true = Counter(), sum(parts, Counter())
        for p in parts:
            sketch = running.merged(sketch, p, k)
        assert len(sketch) <= k and all(true[x] - true.total() / (k + 1) <= sketch[x] <= true[x] for x in true)
    clean = {r.doc_id: r.text for r in running.without_running_lines(df, running.running_lines(df, 0.1)).collect()}
    assert clean[500] is None and clean[501] == "" and not any("Footer" in (t or "") or "Report" in (t or "") for t in clean.values())
    assert all(clean[k].count("\n") == t.count("\n") and clean[k].count("body") == t.count("body") for k, _, t in docs)


@tables
def test_registered_queries_without_sql(spark):
    assert registry.language_confusion(spark, DATA).count() > 3
    assert registry.token_window_chunks(spark, DATA).agg(F.max("n_tokens")).first()[0] <= 128
    log = registry.edit_log(spark, DATA)
    c = registry._curated(spark, DATA)
    chain = curation.delete(curation.reject(curation.accept(c, c.where("doc_id % 5 = 0").select("example_id")), c.where("doc_id % 3 = 0").select("example_id")), c.where("doc_id % 4 = 1").select("example_id"))
    assert Counter(map(tuple, log.collect())) == Counter(map(tuple, chain.select("example_ord", "reason").collect()))

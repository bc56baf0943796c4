"""Files to a data set on ids that are strings; range ranking; packing by jump pointers; web pages."""

import json
import os
import random
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom import config, registry
from sparkloom.functions import packing
from sparkloom.operators import chunking, dashboard, dataset, generation, ingest, markup, planning, ranking, semantic
from sparkloom.sources import staging

DATA = "/root/testdata/sf0.001"


def test_files_become_a_data_set(spark, tmp_path):
    rnd = random.Random(3)
    (tmp_path / "in").mkdir()
    for k in range(6):
        pages = ["\n".join(" ".join(rnd.choice(["alpha", "beta", "42", "however", "missing", "gamma"]) for _ in range(20 + 10 * k)) for _ in range(3)) for p in range(3)]
        (tmp_path / "in" / f"file {k}.txt").write_text("\f".join(pages))
    settings = config.resolved({"chunking": {"target_tokens": 60, "overlap": 8}, "generation": {"page_batch_size": 4, "targets_per_chunk": 2}, "filters": {"preset": "permissive"}, "review": {"sample_size": 5}})
    run = lambda teacher, judge: dataset.from_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), [ingest.PlainText()], teacher, judge, settings, "*.txt")
    counts = run(generation.EchoTeacher(), generation.EchoJudge())
    assert counts["train"] and counts["eval"] and counts["review"] == 5
    read = lambda name: [json.loads(x) for f in (tmp_path / "out" / "exports" / name).glob("part-*") for x in f.read_text().splitlines()]
    train, held = read("train.jsonl"), read("eval.jsonl")
    assert len(train) == counts["train"] and len(held) == counts["eval"]
    assert not {r["metadata"]["doc_id"] for r in train} & {r["metadata"]["doc_id"] for r in held} and all(r["metadata"]["doc_id"].startswith("file-") for r in train)
    assert "- Documentos: 6" in "".join(f.read_text() for f in (tmp_path / "out" / "reports" / "report.md").glob("part-*"))
    # what is done is not asked for again
    assert run(None, None) == counts
    with pytest.raises(RuntimeError, match="train"):
        dataset.from_folder(spark, str(tmp_path / "in"), str(tmp_path / "strict"), [ingest.PlainText()], generation.EchoTeacher(), generation.EchoJudge(), config.with_quality(settings, overall=1.0, groundedness=1.0) | {"generation": settings["generation"] | {"targets_per_chunk": 1, "mix": {"unanswerable": 1.0}}, "filters": {"preset": "strict", "groundedness_threshold": 1.0, "overall_threshold": 1.0}}, "*.txt")


def test_numbers_in_groups_of_any_size_on_any_key(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("aab") if k % 7 else None, f"id-{rnd.randint(0, 10**6)}", rnd.randint(0, 5)) for k in range(3000)] + [("hot", "same", 1)] * 2000
    df = spark.createDataFrame(rows, "g string, id string, m long").repartition(5)
    for name, order, key in (("up", [F.col("id"), F.col("m")], lambda r: (r[1], r[2])), ("down", [F.desc("id"), F.desc("m")], lambda r: (r[1], r[2]))):
        got, sums = ranking.numbered(df, ["g"], order, name).collect(), ranking.numbered(df, ["g"], order, name, mass="m").collect()
        for g in ("a", "b", None, "hot"):
            own = sorted([r for r in rows if r[0] == g], key=key, reverse=name == "down")
            assert [tuple(r)[:3] for r in sorted((r for r in got if r.g == g), key=lambda r: r[name])] == own and sorted(r[name] for r in got if r.g == g) == list(range(len(own)))
            ends = sorted((r[name], r.m) for r in sums if r.g == g)
            assert all(a + m == b for (a, m), (b, _) in zip(ends, ends[1:], strict=False) if m) and ends[-1][0] + ends[-1][1] == sum(r[2] for r in own)


def test_ranges_hold_even_shares_whatever_the_keys(spark):
    for ids in ([*range(20_000), 9 * 10**18], [7] * 20_001, [2**k % (10**9 + 7) for k in range(20_001)]):
        df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(4)
        sizes = [r["count"] for r in ranking.ranged(df, ["id"], parts=16).groupBy(ranking.PART).count().collect()]
        assert sum(sizes) == 20_001 and max(sizes) <= 2 * 20_001 / 16


def plain_split(sizes, ratio=0.15):
    order, total, mass, out = sorted(sizes, key=lambda x: (x[1], x[0]), reverse=True), sum(max(1, n) for _, n in sizes), 0, {}
    for k, (d, n) in enumerate(order):
        out[d] = "eval" if mass < max(1, int(total * ratio)) and k < len(order) - 1 else "train"
        mass += max(1, n)
    return out


@pytest.mark.parametrize("sizes", [[5] * 40, [0] * 9, [1, 2, 3], [100, 1, 1, 1], list(range(60)), [1000] + [3] * 50, [2, 2]])
def test_splits_of_string_ids(spark, sizes):
    rows = [(f"doc {k:03d}", n) for k, n in enumerate(sizes)]
    got = planning.split_manifest(spark.createDataFrame(rows, "doc_id string, tokens long"))
    assert {r.doc_id: r.split for r in got.collect()} == plain_split(rows)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_batches_of_string_ids(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(60):
        at = 1
        for c in range(rnd.randint(1, 5)):
            end = at + rnd.randint(0, 12)
            rows.append(("train" if k % 3 else "eval", f"d{k:02d}", f"d{k:02d}-{c}", c, at, end))
            at = max(at, end + rnd.randint(-1, 1))
    got = {r.chunk_id: r.batch_no for r in chunking.page_batches(spark.createDataFrame(rows, "split string, doc_id string, chunk_id string, chunk_ord long, page_start long, page_end long"), 20, blocks=5).collect()}
    for split in ("train", "eval"):
        batch, pages = 0, set()
        for _, d, c, _, a, b in sorted(r for r in rows if r[0] == split):
            new = {(d, p) for p in range(a, b + 1)}
            if pages and len(pages | new) > 20:
                batch, pages = batch + 1, set()
            pages |= new
            assert got[c] == batch, c


def folded(sizes, limit, fits):
    starts, mass = [], 0
    for i, n in enumerate(sizes):
        if not i or (mass + n > limit if fits else mass >= limit):
            starts.append(i)
            mass = 0
        mass += n
    return starts


def test_groups_by_jump_pointers():
    rnd = random.Random(2)
    rows = [[rnd.choice([0, 0, 1, 3, 9, 40]) for _ in range(rnd.choice([0, 1, 2, 17, 200]))] for _ in range(60)]
    column = pa.array([*rows, None, [5] * 3], pa.list_(pa.int64())).slice(3)
    for limit in (0, 1, 9, 30, 500):
        for fits in (True, False):
            assert packing.group_starts(column, limit, fits).to_pylist() == [folded(r, limit, fits) for r in rows[3:]] + [None, folded([5] * 3, limit, fits)]


def test_long_texts_are_cut_in_time_in_proportion(spark):
    import time

    took = []
    for n in (5_000, 40_000):
        text = "\n".join(x for k in range(n // 2) for x in (f"{'#' * (1 + k % 3)} Heading {k}", "some words of text here"))
        df = spark.createDataFrame([(1, "s", text)], "doc_id long, source string, text string")
        began = time.time()
        rows = semantic.semantic_chunks(df, 64, 8).count()
        took.append(time.time() - began)
        assert rows >= n // 64
    assert took[1] < 8 * max(took[0], 2.5)


class Plain(HTMLParser):
    """A reading of whole, well-formed pages: the text between tags of blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.words, self.linked, self.open, self.skip = [], [], 0, [], 0

    def cut(self):
        text = " ".join("".join(self.words).split())
        if text:
            self.out.append((next((t for t in reversed(self.open) if t in ("h1", "h2", "h3", "li", "title")), "text"), text, self.linked))
        self.words, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "p" and "p" in self.open:
            self.handle_endtag("p")
        if tag not in markup.INLINE:
            self.cut()
        self.skip += tag in ("script", "style")
        if tag not in markup.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open:
                if self.open[-1] not in markup.INLINE:
                    self.cut()
                last = self.open.pop()
                self.skip -= last in ("script", "style")
                if last == tag:
                    break

    def handle_data(self, data):
        if not self.skip:
            self.words.append(data)
            self.linked += len("".join(data.split())) if "a" in self.open else 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
def test_blocks_of_all_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: [(b.kind, b.level, b.text, b.link_chars) for b in r.blocks] for r in markup.page_blocks(pages.select("page_id", "html")).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html or "")
        plain.close()
        plain.cut()
        kind = {"li": "item", "title": "title", "text": "text"}
        want = [(kind.get(t, "heading"), int(t[1]) if t[0] == "h" else 0, x, n) for t, x, n in plain.out]
        assert got[r.page_id] == want, r.page_id
    named = registry.page_blocks(spark, DATA)
    assert named.count() == sum(map(len, got.values()))


def test_broken_markup_has_a_reading():
    read = lambda html: [(b["kind"], b["text"]) for b in markup.blocks_of(html)]
    assert read(None) == read("") == read("<p></p><!-- never closed") == []
    assert read("a < b &amp; c<p>one<p>two</div></b>three<ul><li>x<li>y<ul><li>z</ul></ul>") == [("text", "a < b & c"), ("text", "one"), ("text", "twothree"), ("item", "x"), ("item", "y"), ("item", "z")]
    assert read("<h2>Big <i>deal</i><p>text</h2> tail") == [("heading", "Big deal"), ("heading", "text"), ("text", "tail")]
    assert read("<script>if (a<b) '</p>'</SCRIPT>after<style>x") == [("text", "after")]
    assert read('<a title="x > y" href=\'q\'>in</a> out <b title="open>bold</b>') == [("text", "in out bold")]
    assert read("<table><caption>C</caption><tr><td>1<td>2 <b>b</b><p>c</p><tr><th>3</th></table>end") == [("caption", "C"), ("row", "1 | 2 b c"), ("row", "3"), ("text", "end")]
    assert read("<table><tr><td>a<table><tr><td>in</table>b</td></tr></table>") == [("row", "in"), ("row", "a b")]
    deep = markup.blocks_of("<div>" * 5000 + "x" + "</div>" * 5000 + "<p>y")
    assert [(b["text"], b["depth"]) for b in deep] == [("x", markup.MOST_DEPTH), ("y", 1)]
    row = markup.blocks_of("<tr><td>no table</td></tr><td>q<li><a href=x>l<p>m</a>n")
    assert [(b["text"], b["link_chars"]) for b in row] == [("no table", 0), ("q", 0), ("l", 1), ("m", 1), ("n", 0)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
def test_a_plan_of_web_pages_on_string_ids(spark):
    chunks = registry.web_chunks(spark, DATA).collect()
    plan = registry.web_plan(spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/pages.parquet").count()
    assert len({r.doc_id for r in chunks}) <= docs and {r.chunk_id for r in plan} <= {r.chunk_id for r in chunks} and all("/" in r.doc_id for r in chunks)
    # as many targets as chunks, in batches of either split
    assert len(plan) == len(chunks) and {r.batch.split("-")[0] for r in plan} == {"train", "eval"}
    assert all(n == 1 for n in Counter((r.batch, r.kind, r.pick) for r in plan).values())


def test_score_vectors_come_back_from_their_counts(spark):
    rows = [("j", "train", "x", None if k % 5 else "bad", 0.5 + k % 3 / 10 if k % 7 else None, k % 4 / 4) for k in range(50)]
    df = spark.createDataFrame(rows, "job_id string, split string, question_type string, reason string, overall double, relevance double")
    got = dashboard.job_metrics(df).select("*", *[dashboard.score_vector(F.col(f"{s}_counts")).alias(s) for s in ("overall", "relevance", "groundedness")]).first()
    ok = [r for r in rows if r[3] is None]
    assert (got.accepted, got.rejected) == (len(ok), 50 - len(ok)) and got.groundedness == []
    assert got.overall == sorted(r[4] for r in ok if r[4] is not None) and got.relevance == sorted(r[5] for r in ok)


def test_only_images_that_exist_are_attached(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "x"]), (2, ["x"]), (3, None), (4, [])], "id long, page_image_paths array<string>")
    kept = generation.existing_images(rows, "id", spark.createDataFrame([("a",), ("b",), ("b",)], "path string"))
    assert {r.id: r.page_image_paths for r in kept.collect()} == {1: ["b", "a", "b"], 2: [], 3: None, 4: []}
    parts = kept.where("id = 1").select(generation.image_parts(F.array(F.struct("page_image_paths")), 1).alias("p")).first()
    assert parts.p == ["b"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
@pytest.mark.parametrize("name", ["target_plan", "generated_examples", "split_manifest", "document_chunks"])
def test_a_query_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(staging, "shared_dir", lambda _: str(tmp_path))
    df = registry.QUERIES[name](spark, DATA)
    assert df.count() > 0
    left = {p.name for p in tmp_path.iterdir()}
    assert left == {f.split("/")[-2] for f in df.inputFiles() if "/sparkloom-" in f}
    staging.forget(df)
    assert not list(tmp_path.iterdir())

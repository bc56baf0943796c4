"""All queries by name, each ``(spark, sf_dir) -> DataFrame``; their SQL is in :mod:`sparkloom.plans.sql`."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import headings, maths
from sparkloom.functions import text as T
from sparkloom.functions.frames import long_columns as _long
from sparkloom.operators import chunking, curation, dashboard, editlog, generation, ingest, jobs, language, markup, paging, planning, reporting, running, search, semantic
from sparkloom.plans.build_sql import SQL  # noqa: F401
from sparkloom.sources import files, tables
from sparkloom.sources.staging import shared_dir, staged, temporary
from sparkloom.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return tables.documents(spark, d)


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", F.sha1(T.normalize_text(F.col("text"))).alias("text_hash"), F.length(T.normalize_text(F.col("text"))).cast("long").alias("n_chars"))


def doc_token_counts(spark, d):
    return _tokens(spark, d)


def doc_ids(spark, d):
    stem = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    path = F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), stem, F.lit(".pdf"))
    return _docs(spark, d).select("doc_id", files.document_name(path).alias("document"))


def page_assets(spark, d):
    text = F.col("page_text")
    visual = T.has_any(text, T.FORMULA_MARKERS)
    return tables.pages(_docs(spark, d)).select("doc_id", "page_no", F.length(text).cast("long").alias("text_chars"), visual.alias("visual"), (visual | (F.length(text) < 80)).alias("requires_multimodal"))


def parser_guard(spark, d):
    pages = tables.paged_documents(_docs(spark, d)).select("doc_id", F.size("pages").cast("long").alias("page_count"))
    ram = 4096 - F.col("doc_id") % 3000
    return pages.withColumn("skip_reason", ingest.skip_reason(F.col("page_count"), ram, 3, 3072))


def ocr_pages(spark, d):
    """Each second page stands for one that only OCR can read."""
    pages = tables.pages(_docs(spark, d)).withColumn("ocr_text", F.when((F.col("doc_id") + F.col("page_no")) % 2 == 0, F.col("page_text")))
    raw = pages.withColumn("raw_text", F.when(F.col("ocr_text").isNotNull(), F.substring("page_text", 1, 30)).otherwise(F.col("page_text"))).withColumn("has_images", F.col("page_no") % 3 == 0)
    rows = ingest.read_pages(raw.drop("page_text"))
    return rows.select("doc_id", "page_no", F.sha1("page_text").alias("text_hash"), F.length("page_text").cast("long").alias("text_chars"), "ocr_used", "visual", "requires_multimodal")


def page_formulas(spark, d):
    pages = ingest.marked_pages(tables.pages(_docs(spark, d)))
    return pages.where("expressions > 0").select("doc_id", "page_no", "expressions", F.sha1("page_text").alias("text_hash"))


def heading_lines(spark, d):
    line = F.regexp_replace("line", r"^[ \t\r]+|[ \t\r]+$", "")
    return tables.lines(_docs(spark, d)).where(headings.is_heading(line)).select("doc_id", F.col("pos").cast("long").alias("line_no"), line.alias("heading"))


def math_marks(spark, d):
    lines = maths.with_lines(_docs(spark, d).select("doc_id", "text").where("text is not null"), "text")
    return lines.select("doc_id", maths.formulas(F.col("lines")).alias("expressions"), F.sha1(maths.mark(F.col("lines"))).alias("text_hash"))


def heading_levels(spark, d):
    found = tables.lines(_docs(spark, d)).withColumn("line", T.strip(F.col("line"))).withColumn("level", headings.level(F.col("line")))
    return found.where("level > 0").select("doc_id", F.col("pos").cast("long").alias("line_no"), F.col("level").cast("long").alias("level"), headings.title(F.col("line")).alias("title"))


def document_sections(spark, d):
    return semantic.sections(_docs(spark, d)).withColumn("text_hash", F.sha1("text")).drop("text")


def section_tree(spark, d):
    rows = semantic.tree(_docs(spark, d)).select("doc_id", F.posexplode("nodes").alias("node_ord", "x")).select("doc_id", "node_ord", "x.*")
    return _long(rows.withColumn("text_hash", F.sha1("text")).drop("text"), "node_ord", "level", "page_start", "page_end")


def merged_sections(spark, d):
    rows = semantic.merged_sections(semantic.chapters(semantic.tree(_docs(spark, d))), 128).select("doc_id", F.posexplode("merged").alias("section_ord", "x")).select("doc_id", "section_ord", "x.*")
    return _long(rows.withColumn("text_hash", F.sha1("text")).drop("text"), "section_ord", "page_start", "page_end")


def semantic_chunks(spark, d):
    return semantic.semantic_chunks(_docs(spark, d), 256, 32).withColumn("text_hash", F.sha1("text")).drop("text", "source")


def word_window_chunks(spark, d):
    return chunking.word_windows(_docs(spark, d), 128, 16)


def _chunks(spark, d):
    return chunking.chunk_ids(chunking.page_windows(tables.paged_documents(_docs(spark, d))))


def page_limit_chunks(spark, d):
    return _chunks(spark, d).select("doc_id", "chunk_id", "chunk_ord", F.col("page_start").cast("long"), F.col("page_end").cast("long"), F.sha1("text").alias("text_hash"))


def chunk_coverage(spark, d):
    return chunking.coverage(tables.paged_documents(_docs(spark, d)))


def _ingested(spark, d):
    """Documents with their pages, sections and page assets; each third stands for one without sections."""
    docs = _docs(spark, d)
    rows = ingest.ingested(docs, tables.paged_documents(docs))
    return rows.withColumn("sections", F.when(F.col("doc_id") % 3 == 0, F.slice("sections", 1, 0)).otherwise(F.col("sections")))


def document_chunks(spark, d):
    rows = chunking.document_chunks(staged(_ingested(spark, d), "ingested"), 256, 32, max_pages=4, density=2)
    return rows.withColumn("text_hash", F.sha1("text")).withColumn("neighbors", F.array_join("neighbors", ",")).withColumn("page_image_paths", F.array_join("page_image_paths", ",")).drop("text", "source")


def chunk_neighbors(spark, d):
    order = Window.partitionBy("doc_id").orderBy("chunk_ord")
    near = F.filter(F.array(F.lag("chunk_id").over(order), F.lead("chunk_id").over(order)), lambda x: x.isNotNull())
    return _chunks(spark, d).select("doc_id", "chunk_id", "chunk_ord").withColumn("neighbors", F.array_join(near, ",")).select("chunk_id", "neighbors")


def split_manifest(spark, d):
    return planning.split_manifest(staged(_tokens(spark, d), "tokens"))


def kind_quota(spark, d):
    """Quotas for as many targets as a document has words."""
    return planning.kind_quota(_tokens(spark, d).select(F.col("tokens").alias("total")).where("total is not null").distinct())


def _scored(chunks):
    order = Window.partitionBy("doc_id")
    chunks = chunks.withColumn("tokens", T.word_count(F.col("text"))).withColumn("requires_multimodal", T.has_any(F.col("text"), T.FORMULA_MARKERS))
    scored = planning.chunk_scores(chunks.withColumn("n_neighbors", F.lit(0)))
    narrow = scored.select("doc_id", F.col("source").alias("batch"), "chunk_id", "chunk_ord", "tokens", *planning.PLAN_ORDER)
    most = F.max("chunk_ord").over(order)
    around = (F.col("chunk_ord") > 0).cast("long") + (F.col("chunk_ord") < most).cast("long")
    return narrow.withColumn("multi_chunk", F.col("multi_chunk") + around)


def chunk_scores(spark, d):
    return _scored(_chunks(spark, d)).select("chunk_id", "tokens", *planning.PLAN_ORDER)


def target_plan(spark, d):
    # written once: its rows, sizes and cells would otherwise each cut all texts into pages again
    return planning.target_plan(staged(_scored(_chunks(spark, d)), "scored"))


def batched_plan(spark, d):
    """Targets for each batch of pages of a split, with quotas for each."""
    chunks = staged(_chunks(spark, d).drop("source"), "chunks")
    split = split_manifest(spark, d).select("doc_id", "split")
    batches = chunking.page_batches(chunks.join(split, "doc_id"), 50)
    scored = _scored(chunks.withColumn("source", F.lit(""))).drop("batch").join(batches.select("chunk_id", F.concat_ws("-", "split", "batch_no").alias("batch")), "chunk_id")
    return planning.target_plan(staged(scored, "batches"))


def kind_cycle(spark, d):
    return planning.kind_cycle(table(spark, d, "events").select(F.col("event_id").alias("index")))


def selected_chunks(spark, d):
    manifest = split_manifest(spark, d)
    chunks = _chunks(spark, d).select("doc_id", "chunk_id", "chunk_ord")
    some = chunks.where("chunk_ord % 2 = 0").select("chunk_id")
    return planning.selected_chunks(chunks, manifest, "train", manifest.where("doc_id % 3 <> 0").select("doc_id"), some).select("chunk_id")


def _targets(spark, d):
    ex = tables.examples(table(spark, d, "conversations"))
    return ex.select(F.col("example_ord").alias("ord"), F.get("chunk_ids", F.lit(0)).alias("chunk_id"), F.col("requested_kind").alias("kind"), "doc_id", "question_type", "chunk_ids")


def pending_targets(spark, d):
    ex = tables.examples(table(spark, d, "conversations"))
    # each second of those that exist doesn't say what was asked for
    done = ex.where("doc_id % 4 = 0 and example_ord % 2 = 0").withColumn("requested_kind", F.when(F.col("doc_id") % 8 == 0, F.col("requested_kind")))
    return planning.pending_targets(_targets(spark, d).select("ord", "chunk_id", "kind"), planning.existing_targets(done))


def pending_chunks(spark, d):
    t = _targets(spark, d)
    return t.select("chunk_id").distinct().join(t.where("doc_id % 4 = 0").select("chunk_id"), "chunk_id", "left_anti")


def _examples(spark, d, manifest=None):
    ex = curation.example_id(tables.examples(table(spark, d, "conversations")))
    manifest = split_manifest(spark, d) if manifest is None else manifest
    return ex.join(manifest.select("doc_id", "split"), "doc_id")


def question_types(spark, d):
    return _examples(spark, d).groupBy("question_type", T.question_type(F.col("question_type")).alias("kind")).agg(F.count("*").alias("n"))


def example_ids(spark, d):
    return _examples(spark, d).select("example_ord", "example_id")


def evidence_resolution(spark, d):
    # placeholders and blanks among what was given; the question stands for the fragment's text
    given = F.concat("evidence", F.array(F.lit(" Fragmento 2"), F.lit("EVIDENCIA"), F.lit("\t \n"), F.lit("fragmentos")))
    resolved = generation.resolved_evidence(given, F.array("question"), F.col("is_answerable"))
    return _examples(spark, d).select("example_ord", F.size(resolved).cast("long").alias("n_evidence"), F.sha1(F.array_join(resolved, "|")).alias("evidence_hash"))


def _curated(spark, d, manifest=None):
    return curation.curate(_examples(spark, d, manifest))


def curation_reasons(spark, d):
    return _curated(spark, d).select("example_ord", "reason")


def curation_summary(spark, d):
    return curation.summary(_curated(spark, d), "split")


def training_records(spark, d):
    records = curation.training_records(_curated(spark, d).where("reason is null"))
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    plain = records.select("example_ord", F.sha1(joined).alias("messages_hash"), "metadata.*")
    return plain.withColumn("chunk_ids", F.array_join("chunk_ids", ",")).withColumn("page_range", F.array_join(F.transform("page_range", lambda x: x.cast("string")), "-"))


def review_sample(spark, d):
    return curation.review_sample(_curated(spark, d).where("reason is null"))


def report_counts(spark, d):
    c = _curated(spark, d)
    return c.groupBy("split").agg(F.count("*").alias("generated"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.count_distinct("doc_id").alias("documents"))


def examples_filtered_page(spark, d):
    rows = dashboard.filtered(_curated(spark, d), split="train", accepted=True, kind="extractive", min_score=0.75)
    return dashboard.page(rows, limit=25, offset=2).select("example_ord", "example_id", "overall")


def examples_search(spark, d):
    return dashboard.filtered(_curated(spark, d), search="OC-1").select("example_ord", "question_type")


def _job_dim(spark, d):
    return _examples(spark, d).select("job_id").distinct().select("job_id", F.lit("2024-01-01").alias("created_at"), F.substring("job_id", 5, 9).cast("long").alias("ord"))


def examples_of_jobs(spark, d):
    """A page of the three latest jobs' examples, with the total."""
    rows = dashboard.of_latest_jobs(dashboard.filtered(_curated(spark, d), accepted=dashboard.accepted_flag(" Yes ")), _job_dim(spark, d), 3)
    return dashboard.page_with_total(rows, limit=40, offset=5).select("example_ord", "example_id", "job_id", "total")


def examples_sorted(spark, d):
    rows = dashboard.ordered(_curated(spark, d), "score").limit(50)
    return rows.select("example_ord", F.coalesce("overall", F.lit(0.0)).alias("overall"))


def selected_rows(spark, d):
    c = _curated(spark, d).withColumn("accepted", F.col("reason").isNull())
    return dashboard.selected_rows(c, c.where("doc_id % 6 = 0").select("job_id", "example_id", "split")).withColumn("question", F.sha1("question")).withColumn("answer", F.sha1("answer")).withColumn("evidence", F.size("evidence").cast("long"))


def job_metrics(spark, d):
    relevance = F.when(F.col("overall").isNotNull(), (50 + F.col("doc_id") * 7 % 51) / F.lit(100.0))
    rows = dashboard.job_metrics(_curated(spark, d).withColumn("relevance", relevance))
    shown = lambda s: F.array_join(F.transform(f"{s}_counts", lambda c: F.concat(F.round(c["value"] * 100).cast("long").cast("string"), F.lit("x"), c["n"].cast("string"))), ",").alias(s)
    return rows.select("job_id", "split", "question_type", "accepted", "rejected", *map(shown, ("relevance", "groundedness", "overall")))


def job_stats(spark, d):
    return dashboard.stat_sums(curation.edges_by_job(_curated(spark, d)))


def curation_totals(spark, d):
    rows = curation.totals(_curated(spark, d), "split")
    why = F.array_join(F.array_sort(F.transform(F.map_entries("rejected_by_reason"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    return rows.withColumn("rejected_by_reason", why)


def editor_find(spark, d):
    c = _curated(spark, d)
    ids = c.where("doc_id % 5 = 0").select("example_id").union(spark.createDataFrame([("nowhere",)], "example_id string"))
    return curation.find(c, ids)


def editor_bulk(spark, d):
    c = _curated(spark, d)
    return curation.bulk_edit(c, c.where("doc_id % 10 = 3").select("example_id"), "reject", "not wanted").select("example_ord", "reason")


def source_mode(spark, d):
    return reporting.source_mode(_docs(spark, d))


def link_names(spark, d):
    names = _docs(spark, d).select(F.col("doc_id").alias("ord"), F.concat(F.lit("/in/"), F.col("source"), F.lit("/report"), (F.col("doc_id") % 50).cast("string"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("-"), (F.col("doc_id") % 4 + 1).cast("string"))).otherwise(""), F.lit(".pdf")).alias("path"))
    return files.link_names(names.where("ord is not null")).select("ord", "name")


def type_distribution(spark, d):
    return dashboard.type_distribution(dashboard.filtered(_curated(spark, d), min_score=0.5))


def per_job_counts(spark, d):
    return curation.edges_by_job(_curated(spark, d))


def score_histogram(spark, d):
    return dashboard.histogram(_curated(spark, d).where("reason is null"))


def editor_accept(spark, d):
    c = _curated(spark, d)
    return curation.accept(c, c.where("doc_id % 5 = 0").select("example_id")).select("example_ord", "reason", "overall")


def editor_reject(spark, d):
    c = _curated(spark, d)
    return curation.reject(c, c.where("doc_id % 3 = 0").select("example_id")).select("example_ord", "reason")


def _events(spark, d):
    return tables.job_events(table(spark, d, "events"))


def job_latest_state(spark, d):
    return jobs.latest_state(_events(spark, d))


def job_list(spark, d):
    return jobs.job_list(_events(spark, d), 20)


def job_stats_kept(spark, d):
    """Events of which each third says how far a job is."""
    e = _events(spark, d).withColumn("stats", F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")))
    return jobs.latest_state(e).select("job_id", "stats")


def job_progress(spark, d):
    """Conversations stand for batches, their turns for pages; 64 are a job."""
    k = F.col("conv_id")
    batches = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("pages")).select(
        F.floor(k / 64).alias("job_id"), F.when(k % 2 == 0, "train").otherwise("eval").alias("split"), F.floor(k % 64 / 2).alias("batch"), "pages", (k % 5 * 1.5).cast("double").alias("seconds"))
    rows = jobs.progress(batches, "job_id", "split")
    return rows.withColumn("percent", F.round(jobs.milestone(F.concat(F.lit("generate_"), "split"), F.col("batch"), F.col("total_batches")), 6))


def structured_calls(spark, d):
    e = table(spark, d, "events")
    kind = F.element_at(F.array(*map(F.lit, ("retryable", "ok", "malformed", "retryable", "permanent", "retryable", "malformed"))), ((F.col("event_id") * F.col("event_id") + F.floor(F.col("event_id") / 97)) % 7 + 1).cast("int"))
    replies = e.select(F.concat(F.lit("call-"), (F.col("event_id") % 97).cast("string")).alias("name"), F.col("event_id").alias("attempt"), kind.alias("error_class"), F.when(F.col("event_id") % 3 == 0, "Unknown Response_Format").otherwise("no").alias("message"), F.when(F.col("event_id") % 11 == 0, F.lit(2.5)).alias("retry_after"))
    return jobs.structured_calls(replies)


def shown_values(spark, d):
    n = F.col("n_chars")
    seconds = (n * n / 20.0).cast("double")
    return _docs(spark, d).where("n_chars is not null").select("doc_id", n.alias("n"), T.eta(seconds).alias("eta"), T.percent(n / 3000.0).alias("percent"), T.relative(seconds).alias("ago"))


def active_job(spark, d):
    return jobs.active_job(_events(spark, d))


def event_tail(spark, d):
    e = _events(spark, d)
    return jobs.tail(e, 500).select("event_id", "job_id", "status")


def retry_backoff(spark, d):
    attempt = F.col("event_id") % 12 + 1
    return jobs.backoff(table(spark, d, "events").select(attempt.alias("attempt"), F.when(attempt % 5 == 0, F.lit(7)).alias("retry_after")))


def breaker_failure_rate(spark, d):
    return jobs.failure_rate(_events(spark, d))


def lexical_neighbors(spark, d):
    return chunking.lexical_neighbors(_chunks(spark, d)).select("chunk_id", F.array_join("neighbors", ",").alias("neighbors"))


def page_batches(spark, d):
    chunks = staged(_chunks(spark, d).select("doc_id", "chunk_id", "chunk_ord", "page_start", "page_end"), "page-ranges")
    return chunking.page_batches(chunks.join(split_manifest(spark, d).select("doc_id", "split"), "doc_id"), 50)


def coverage_fallback(spark, d):
    return chunking.needs_fallback(semantic.semantic_chunks(_docs(spark, d), 256, 32), tables.paged_documents(_docs(spark, d)), 256, 32)


def dense_windows(spark, d):
    return _long(chunking.dense_windows(tables.paged_documents(_docs(spark, d)), 2).withColumn("text_hash", F.sha1("text")).drop("text"), "page_start", "page_end")


def _described(chunks):
    return chunks.withColumnRenamed("source", "batch").withColumn("heading", F.lit(""))


def chunk_summaries(spark, d):
    return generation.summaries(_described(_chunks(spark, d))).select("batch", "summary", F.sha1("context").alias("context_hash"))


def _contexts(spark, d):
    """Targets with their fragments, and the batches' summaries. Chunks are written once; neighbours, targets and summaries read them from there."""
    chunks = staged(_chunks(spark, d), "chunks")
    targets = planning.target_plan(staged(_scored(chunks), "scored"))
    described = _described(chunks)
    return generation.contexts(targets, described.join(chunking.lexical_neighbors(chunks), "chunk_id")), generation.summaries(described)


def generation_prompts(spark, d):
    return generation.prompts(*_contexts(spark, d)).select("batch", "kind", "pick", "chunk_id", "asked", F.sha1("system").alias("system_hash"), F.sha1("user").alias("user_hash"))


def generated_examples(spark, d):
    context, about = _contexts(spark, d)
    context = staged(context, "contexts")
    # prompts are put together where they are asked, and written nowhere
    answers = generation.generate(generation.prompts(context, staged(about, "summaries")), generation.EchoTeacher())
    rows = generation.judge_prompts(generation.examples_of(answers, context))
    return rows.select(
        "batch", "kind", "pick", "chunk_id", "example_id", "question_type", "is_answerable", "matches", "attempts", F.sha1("answer").alias("answer_hash"), F.size("evidence").cast("long").alias("n_evidence"),
        F.sha1(F.array_join("evidence", "|")).alias("evidence_hash"), F.sha1(F.concat("judge_system", "judge_user")).alias("judge_hash"), F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"),
    )


def judged_examples(spark, d):
    ex = _examples(spark, d)
    earlier = ex.where("doc_id % 2 = 0").select("example_id", F.col("example_ord").alias("seq"), *[F.coalesce("overall", F.lit(0.0)).alias(s) for s in generation.SCORES], F.lit("earlier").alias("rationale"))
    return generation.judged(ex, earlier, generation.EchoJudge()).select("example_ord", F.round("overall", 6).alias("overall"), "rationale")


def image_parts(spark, d):
    """Images of a document's fragments: the first ten pages of three windows each, which overlap."""
    docs = ingest.with_assets(tables.paged_documents(_docs(spark, d)))
    paths = F.filter(F.transform("assets", lambda a: a["image_path"]), lambda p: p.isNotNull())
    part = lambda a: F.struct(F.slice(paths, a, 10).alias("page_image_paths"))
    return docs.select("doc_id", F.array_join(generation.image_parts(F.array(part(1), part(6), part(11)), 12), ",").alias("images"))


def judge_scores(spark, d):
    x = F.concat(F.lit("0."), (50 + F.col("example_ord") % 50).cast("string"))
    quote = F.when(F.col("example_ord") % 7 == 2, '"').otherwise("")
    body = F.concat(F.lit('{"relevance": 0.5, "groundedness": '), quote, x, quote, F.lit(', "format": 1, "difficulty": 0.25, "overall": '), x, F.lit(', "rationale": "ok"}'))
    raw = F.when(F.col("example_ord") % 7 == 0, "no JSON").when(F.col("example_ord") % 7 == 1, F.replace(body, F.lit('"overall"'), F.lit('"total"'))).otherwise(body)
    return generation.judge_scores(_examples(spark, d).select("example_ord", raw.alias("response"))).drop("response")


def score_reuse(spark, d):
    ex = _examples(spark, d)
    scored = ex.where("doc_id % 2 = 0").select("example_id", F.col("example_ord").alias("seq"), "overall", "groundedness")
    return generation.adopt_scores(ex, scored).select("example_ord", "overall", "groundedness")


def dataset_mode(spark, d):
    return reporting.dataset_mode(split_manifest(spark, d))


def export_guard(spark, d):
    manifest = split_manifest(spark, d)
    return reporting.export_guard(_curated(spark, d, manifest), reporting.dataset_mode(manifest))


def review_fill(spark, d):
    return reporting.review_fill(_curated(spark, d).where("reason is null"), 200)


def report_lines(spark, d):
    manifest = split_manifest(spark, d)
    return reporting.report(_curated(spark, d, manifest), reporting.dataset_mode(manifest), _docs(spark, d), _chunks(spark, d))


def editor_patch(spark, d):
    c = _curated(spark, d)
    patches = c.where("doc_id % 9 = 0").groupBy("example_id").agg(F.lit("edited").alias("question"))
    return curation.patch(c, patches).select("example_ord", "example_id", F.sha1("question").alias("question_hash"), "reason")


def editor_delete(spark, d):
    c = _curated(spark, d)
    return curation.delete(c, c.where("doc_id % 4 = 1").select("example_id")).select("example_ord", "reason")


def call_errors(spark, d):
    e = table(spark, d, "events")
    status = F.when(F.col("event_id") % 9 == 8, None).otherwise(F.element_at(F.array(*map(F.lit, (200, 200, 400, 401, 403, 408, 429, 503))), (F.col("event_id") % 9 + 1).cast("int")))
    message = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("<html>")
    return e.groupBy(jobs.error_class(status, message).alias("error_class")).agg(F.count("*").alias("n"))


def breaker_states(spark, d):
    e = table(spark, d, "events")
    calls = e.select(F.concat(F.lit("job-"), (F.col("user_id") % 20).cast("string")).alias("name"), F.col("event_id").alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), ((F.col("event_id") * 7 + F.floor(F.col("event_id") / 1300)) % 5 < 2).alias("failed"))
    return jobs.breaker_states(calls)


def phase_plan(spark, d):
    """Events stand for runs that got so far, are resumed or not, or start at a phase."""
    k = F.col("event_id")
    names = F.array(*map(F.lit, jobs.PHASES))
    runs = table(spark, d, "events").select(k.alias("run_id"), F.slice(names, 1, (k % 8).cast("int")).alias("completed"), (k % 24 < 16).alias("resume"), F.when(k % 5 == 4, F.element_at(names, (k % 8 + 1).cast("int"))).alias("from_phase"))
    return jobs.phase_plan(runs)


def text_measures(spark, d):
    w, h = F.col("n_chars") % 3000, F.col("doc_id") % 2000
    return _docs(spark, d).select("doc_id", T.image_tokens(w, h).alias("image_tokens"), T.language_name(F.col("lang")).alias("language"), T.truncated(F.col("text"), 40).alias("shown"), F.size(T.token_set(F.col("text"))).cast("long").alias("n_distinct"), T.language(F.col("text"), "en").alias("detected"))


def running_lines(spark, d):
    return running.running_lines(_docs(spark, d))


def pages_without_running_lines(spark, d):
    """The documents that lose a running header or footer, by digest."""
    docs = _docs(spark, d)
    found = staged(running.running_lines(docs), "running-lines")
    rows = running.without_running_lines(docs.withColumn("before", F.sha1("text")), found)
    return rows.where(F.sha1("text") != F.col("before")).select("doc_id", F.sha1("text").alias("text_hash"))


def language_confusion(spark, d):
    """Languages by learned profiles against those given, on the documents that were not learned from."""
    docs = _docs(spark, d)
    return language.confusion(language.detected(docs, language.learned(docs)))


def token_window_chunks(spark, d):
    rows = chunking.token_windows(_docs(spark, d), chunking.PieceTokens, 128, 16)
    return rows.select("doc_id", "chunk_ord", "n_words", "n_tokens", F.sha1("text").alias("text_hash"))


def trigram_search(spark, d):
    """What ``examples_search`` finds, by an index of trigrams."""
    rows = staged(_curated(spark, d), "searched")
    texts = ["question", "answer", "source_doc"]
    path = search.write_index(rows, "example_ord", texts, shared_dir(spark))
    return search.search(rows, "example_ord", texts, path, "OC-1").select("example_ord", "question_type")


def examples_deep_page(spark, d):
    """A page of the accepted examples, with its places, by an ordinal index."""
    index = paging.OrdinalIndex.write(_curated(spark, d).where("reason is null").select("example_ord", "example_id"), ["example_ord"], 64)
    return index.page(40, 10)


def edit_log(spark, d):
    """Examples after three logged edits."""
    log = editlog.EditLog(spark, f"{shared_dir(spark)}/sparkloom-edits-{uuid.uuid4().hex}")
    c = staged(_curated(spark, d), "edited")
    log.begin(c)
    log.append(c.where("doc_id % 5 = 0").select("example_id"), "accept")
    log.append(c.where("doc_id % 3 = 0").select("example_id"), "reject")
    log.append(c.where("doc_id % 4 = 1").select("example_id"), "delete")
    return log.folded().select("example_ord", "reason")


def _page_blocks(spark, d):
    pages = table(spark, d, "pages").select((F.concat(markup.host(F.col("url")), F.lit("/"), F.col("page_id").cast("string"))).alias("page"), F.col("url"), "html")
    return markup.page_blocks(pages, "page")


def page_blocks(spark, d):
    """The blocks of all web pages, by names that are strings."""
    rows = _page_blocks(spark, d).select("page", F.posexplode("blocks").alias("block_ord", "b"))
    return _long(rows.select("page", "block_ord", "b.kind", "b.level", F.sha1("b.text").alias("text_hash"), F.size(F.coalesce("b.cells", F.array().cast("array<string>"))).alias("n_cells"), "b.chars", "b.link_chars", "b.depth"), "block_ord", "level", "n_cells", "chars", "link_chars", "depth")


def _web_documents(spark, d):
    """Web pages as documents with string ids, their hosts as sources."""
    blocks = staged(_page_blocks(spark, d), "blocks")
    return staged(markup.markup_documents(blocks, "page", markup.host(F.col("url"))), "web-documents")


def web_sections(spark, d):
    return semantic.sections(_web_documents(spark, d)).withColumn("text_hash", F.sha1("text")).drop("text")


def _web_chunks(spark, d):
    docs = _web_documents(spark, d)
    ready = staged(ingest.ingested(docs, tables.paged_documents(docs)), "web-ingested")
    return docs, staged(chunking.document_chunks(ready, 256, 32, max_pages=4, density=2), "web-chunks")


def web_chunks(spark, d):
    rows = _web_chunks(spark, d)[1]
    return rows.select("doc_id", "chunk_id", "chunk_ord", "heading", "page_start", "page_end", "n_words", F.sha1("text").alias("text_hash"), "coverage_ratio", "low_coverage")


def web_plan(spark, d):
    """From web pages to targets on string ids: blocks, documents, chunks, split, page batches, and a plan for each batch."""
    docs, chunks = _web_chunks(spark, d)
    split = planning.split_manifest(staged(docs.select("doc_id", T.token_count(F.col("text")).alias("tokens")), "web-tokens"))
    batches = chunking.page_batches(chunks.join(split.select("doc_id", "split"), "doc_id"), 50)
    scored = _scored(chunks.select("doc_id", F.lit("").alias("source"), "chunk_id", "chunk_ord", "text")).drop("batch")
    named = scored.join(batches.select("chunk_id", F.concat_ws("-", "split", "batch_no").alias("batch")), "chunk_id")
    return planning.target_plan(staged(named, "web-scored"))


def scoped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after which only those staged tables are left that its result reads; ``staging.forget`` of the result deletes these."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with temporary() as keep:
            return keep(query(spark, sf_dir))

    return run


QUERIES = {f.__name__: scoped(f) for f in (
    normalize_text, doc_token_counts, doc_ids, page_assets, parser_guard, ocr_pages, page_formulas, heading_lines,
    math_marks, heading_levels, document_sections, section_tree, merged_sections, semantic_chunks, word_window_chunks, page_limit_chunks,
    chunk_coverage, document_chunks, chunk_neighbors, split_manifest, kind_quota, chunk_scores, target_plan, batched_plan,
    kind_cycle, selected_chunks, pending_targets, pending_chunks, question_types, example_ids, evidence_resolution, curation_reasons,
    curation_summary, training_records, review_sample, report_counts, examples_filtered_page, examples_search, examples_of_jobs, examples_sorted,
    selected_rows, job_metrics, job_stats, curation_totals, editor_find, editor_bulk, source_mode, link_names,
    type_distribution, per_job_counts, score_histogram, editor_accept, editor_reject, job_latest_state, job_list, job_stats_kept,
    job_progress, structured_calls, shown_values, active_job, event_tail, retry_backoff, breaker_failure_rate, lexical_neighbors,
    page_batches, coverage_fallback, dense_windows, chunk_summaries, generation_prompts, generated_examples, judged_examples, image_parts,
    judge_scores, score_reuse, dataset_mode, export_guard, review_fill, report_lines, editor_patch, editor_delete,
    call_errors, breaker_states, phase_plan, text_measures, page_blocks, web_sections, web_chunks, web_plan, running_lines, pages_without_running_lines,
    language_confusion, token_window_chunks, trigram_search, examples_deep_page, edit_log,
)}

"""From documents and chunks to a data set on disk: split, page batches, targets, answers, scores, curation, export, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import config
from sparkloom.functions import text as T
from sparkloom.operators import chunking, curation, generation, ingest, jobs, planning, reporting
from sparkloom.operators.ranking import numbered
from sparkloom.sources import files
from sparkloom.sources.staging import staged

KEYS = ["batch", "kind", "pick", "chunk_id"]


def batched_chunks(chunks: DataFrame, split: DataFrame, pages: int) -> DataFrame:
    """``chunks`` with their ``split``, ``batch_no`` and ``batch``, a name of both."""
    placed = chunking.page_batches(chunks.select("doc_id", "chunk_id", "chunk_ord", "page_start", "page_end").join(split, "doc_id"), pages)
    return chunks.join(placed.select("chunk_id", "split", "batch_no", F.concat_ws("-", "split", "batch_no").alias("batch")), "chunk_id")


def planned(chunks: DataFrame, settings: config.Settings) -> DataFrame:
    """Targets of :func:`batched_chunks`, batch by batch."""
    facts = chunks.withColumns({"tokens": T.word_count(F.col("text")), "n_neighbors": F.size("neighbors")})
    scored = planning.chunk_scores(facts).select("batch", "chunk_id", "doc_id", "chunk_ord", "tokens", *planning.PLAN_ORDER)
    return planning.target_plan(staged(scored, "plan-scores"), settings["generation"]["targets_per_chunk"], settings["generation"]["mix"])


def answered(prompted: DataFrame, teacher: generation.Backend, path: str, attempts: int, at_once: int = 64) -> dict[str, int]:
    """Asks for what ``path`` has no answers to yet and appends them, ``at_once`` batches in a job; returns the new answers of each round.

    ``prompted`` needs ``round``, the number of a batch over ``at_once``. What
    an earlier call has written stays, so a run that was stopped goes on there.
    """
    spark, counts = prompted.sparkSession, {}
    for k in sorted(r["round"] for r in prompted.select("round").distinct().collect()):
        rows = prompted.where(F.col("round") == k)
        if files.exists(spark, path):
            rows = rows.join(spark.read.parquet(path).select(*KEYS), KEYS, "left_anti")
        new = staged(generation.generate(rows, teacher, attempts), "answers")
        counts[f"round-{k}"] = new.count()
        if counts[f"round-{k}"]:
            new.write.mode("append").parquet(path)
    return counts


def build(
    spark: SparkSession, documents: DataFrame, chunks: DataFrame, folder: str, teacher: generation.Backend, judge: generation.Backend, settings: config.Settings | None = None, language: str = "en", at_once: int = 64,
) -> dict[str, int]:
    """Makes the data set of ``documents`` and their ``chunks`` (as :func:`sparkloom.operators.ingest.ingest_folder` gives them) under ``folder``.

    Ids may be of any type that has an order. Answers and scores are kept in
    ``work``; a second run asks only for those that are not there. Returns the
    number of rows written per file. Raises what the export's guard finds.
    """
    settings = settings or config.resolved()
    own = settings["generation"]
    sizes = staged(documents.select("doc_id", T.token_count(F.coalesce("text", F.lit(""))).alias("tokens")), "sizes")
    manifest = staged(planning.split_manifest(sizes), "manifest")
    jobs.save_phase(spark, folder, "split")
    named = staged(batched_chunks(chunks, manifest.select("doc_id", "split"), own["page_batch_size"]), "batched-chunks")
    context = generation.contexts(planned(named, settings), named.select("chunk_id", "doc_id", "heading", "page_start", "page_end", "text", "neighbors"))
    context = staged(context.join(named.select("batch", "split", F.floor(F.col("batch_no") / at_once).alias("round")).distinct(), "batch"), "contexts")
    prompted = generation.prompts(context, generation.summaries(named), language)
    answers = f"{folder}/work/answers"
    answered(prompted, teacher, answers, own["max_generation_attempts_per_target"], at_once)
    examples = generation.examples_of(spark.read.parquet(answers), context)
    examples = examples.join(context.select("batch", "split").distinct(), "batch").withColumnRenamed("kind", "requested_kind")
    examples = examples.join(documents.select("doc_id", *[c for c in ("source_doc",) if c in documents.columns]), "doc_id")
    examples = examples.withColumns({"language": F.lit(language), "prompt_version": F.lit(own["prompt_version"])})
    examples = staged(numbered(examples, [], ["split", "batch", "requested_kind", "pick", "chunk_id"], "example_ord"), "examples")
    for split in ("train", "eval"):
        jobs.save_phase(spark, folder, f"generate_{split}")
    scores, names = f"{folder}/work/scores", ["example_id", *generation.SCORES, "rationale"]
    kinds = ", ".join(f"{c} {'double' if c in generation.SCORES else 'string'}" for c in names)
    earlier = spark.read.parquet(scores) if files.exists(spark, scores) else spark.createDataFrame([], kinds)
    rows = staged(generation.judged(examples, earlier.withColumn("seq", F.lit(0)), judge, language), "judged")
    new = rows.select(*names).distinct().join(earlier.select("example_id"), "example_id", "left_anti")
    staged(new, "new-scores").write.mode("append").parquet(scores)
    groundedness, overall = config.thresholds(settings)
    curated = staged(curation.curate(rows, groundedness=groundedness, overall=overall), "curated")
    for split in ("train", "eval"):
        jobs.save_phase(spark, folder, f"judge_{split}")
    mode = staged(reporting.dataset_mode(manifest), "mode")
    counts = reporting.export(curated, mode, f"{folder}/exports", settings["review"]["sample_size"], settings["export"]["require_eval_split"], settings["export"]["allow_partial_export"])
    jobs.save_phase(spark, folder, "export", [f"{folder}/exports/{n}.jsonl" for n in ("train", "eval")], counts)
    lines = reporting.report(curated, mode, documents, chunks).orderBy("part", "ord", "line").select("line")
    lines.coalesce(1).write.mode("overwrite").text(f"{folder}/reports/report.md")  # a few lines
    jobs.save_phase(spark, folder, "report")
    return counts


def from_folder(
    spark: SparkSession, sources: str, folder: str, extractors: Sequence[ingest.PageExtractor], teacher: generation.Backend, judge: generation.Backend, settings: config.Settings | None = None, pattern: str = "*.pdf",
) -> dict[str, int]:
    """:func:`build` of the files under ``sources``, with the settings for chunks and language."""
    settings = settings or config.resolved()
    cut, language = settings["chunking"], settings["parsing"]["default_language"]
    documents, chunks = ingest.ingest_folder(
        spark, sources, extractors, pattern, target=cut["target_tokens"], overlap=cut["overlap"], strategy=chunking.strategy_of(cut["strategy"]), max_pages=cut["max_pages_per_chunk"], language=language)
    jobs.save_phase(spark, folder, "ingest")
    return build(spark, documents, staged(chunks, "chunks"), folder, teacher, judge, settings, language)

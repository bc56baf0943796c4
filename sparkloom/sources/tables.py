"""Inputs: Parquet tables and JSON lines, and the entities made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import text as T
from sparkloom.sources.staging import spread

LINES_PER_PAGE = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def lines(documents: DataFrame) -> DataFrame:
    """``doc_id, pos, line``, from 0."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def page_texts(text: str = "text") -> Column:
    """The pages of a text: five lines each, white space squeezed."""
    lines = F.split(text, "\n")
    starts = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / LINES_PER_PAGE).cast("int"))
    return F.transform(starts, lambda k: T.squeeze(F.array_join(F.slice(lines, k * LINES_PER_PAGE + 1, LINES_PER_PAGE), " ")))


def pages(documents: DataFrame) -> DataFrame:
    """``doc_id, page_no, page_text``, from 1; without a shuffle."""
    cut = documents.where("text is not null").select("doc_id", F.posexplode(page_texts()).alias("k", "page_text"))
    return cut.select("doc_id", (F.col("k") + 1).cast("long").alias("page_no"), "page_text")


def paged_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, source, pages``: the page texts as an array, without a shuffle."""
    # through a generator, so that each use of the pages does not work them out anew
    return documents.select("doc_id", "source", F.explode(F.array(page_texts())).alias("pages"))


def examples(conversations: DataFrame) -> DataFrame:
    """Question-answer examples: each user turn that an assistant turn follows."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    pairs = conversations.withColumn("answer_role", F.lead("role").over(order)).withColumn("reply", F.lead("text").over(order))
    pairs = pairs.where("role = 'user' and answer_role = 'assistant'")
    c, t = F.col("conv_id"), F.col("turn")
    kind = F.element_at(F.array(*map(F.lit, T.KINDS)), ((c * 8 + t) % 5 + 1).cast("int"))
    first = F.concat(F.lit("doc-"), c.cast("string"), F.lit("-chunk-"), t.cast("string"))
    rows = pairs.select(
        (2 * (c * 1_000_000 + t)).alias("example_ord"), c.alias("doc_id"), F.concat(F.lit("job-"), (c % 5).cast("string")).alias("job_id"),
        kind.alias("requested_kind"), F.when((c + t) % 17 == 0, "factoid").otherwise(kind).alias("question_type"),
        F.when(kind == "multi_chunk", F.array(first, F.concat(first, F.lit("b")))).otherwise(F.array(first)).alias("chunk_ids"),
        F.col("text").alias("question"), F.when((kind == "unanswerable") & (c % 3 != 0), T.REFUSAL).otherwise(F.col("reply")).alias("answer"),
        (kind != "unanswerable").alias("is_answerable"), (c % 11 != 0).alias("has_evidence"),
        F.when(c % 13 != 0, (50 + (c * 31 + t * 17) % 51) / F.lit(100.0)).alias("overall"),
        F.when(c % 13 != 0, (50 + (c * 13 + t * 29) % 51) / F.lit(100.0)).alias("groundedness"),
    )
    rows = rows.withColumns({
        "source_doc": F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")), "page_start": F.col("doc_id") % 7 + 1, "page_end": F.col("doc_id") % 7 + 2,
        "difficulty": F.when(F.col("doc_id") % 2 == 0, "medium").otherwise("hard"), "teacher_model": F.lit("echo"), "prompt_version": F.lit("v1"), "language": F.lit("en"),
    })
    again = rows.where("doc_id % 7 = 0").withColumn("example_ord", F.col("example_ord") + 1)
    evidence = F.when(F.col("has_evidence"), F.array("answer")).otherwise(F.array().cast("array<string>"))
    return rows.union(again).withColumn("evidence", evidence).drop("has_evidence")


def job_events(events: DataFrame) -> DataFrame:
    """``event_id, job_id, status, percent, message``."""
    status = {"signup": "queued", "view": "running", "click": "running", "purchase": "completed", "error": "failed"}
    named = F.create_map(*[F.lit(x) for pair in status.items() for x in pair])
    return events.select(
        "event_id", F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.coalesce(F.try_element_at(named, F.col("event_type")), F.col("event_type")).alias("status"),
        F.least(F.col("value") / 500.0, F.lit(1.0)).alias("percent"), F.col("props").alias("message"),
    )

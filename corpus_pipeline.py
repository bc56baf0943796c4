"""From raw documents to packed training bins, in five stages.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import contamination, line_dedup, near_dups, packing, quality
from sparkloom.llm.common import forget, marked, table, temporary, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, with the columns they had.

    Null and empty texts are scored by the bias alone; repeated rows are judged
    alike; a very long text is read whole, in blocks. An empty table stays
    empty, and without labels nothing is rejected. Columns named score or
    predicted are kept as they were.
    """
    names = [c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)]
    judged = quality.score_quality(docs.toDF(*names), table(spark, sf_dir, "labels"))
    return judged.where("predicted = 1").select(names).toDF(*docs.columns)


def with_length(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, where it is a column, counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else docs


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occurred before; wholly repeated ones go.

    The first occurrence is that of the least doc_id and line. Null and empty
    texts stay; rows that repeat a doc_id count as one document and are cut
    alike; rows with a null doc_id stay as they are. A very long text is read
    in blocks, a very long line whole. An empty table stays empty.
    """
    return with_length(line_dedup.dedup_lines(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8.

    The document of the least doc_id stays; null and empty texts are in no
    group. Of rows with the same doc_id and text one stays, the least by its
    other columns. Rows with a null doc_id take no part. A very long text is
    read whole, in blocks. An empty table stays empty; columns may have any names.
    """
    names = [c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)]
    plain = docs.toDF(*names)
    gone = written(near_dups.near_duplicates(plain, percent=80, words=5).where("not kept").select("doc_id"), "copies")
    again = plain.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id")
    asked = marked(plain, "doc_id", written(gone.union(again), "in-question"))
    others = [c for c in names if c not in ("doc_id", "text")]
    rest = asked.where("may").drop("may").join(gone, "doc_id", "left_anti")
    if others:
        rest = rest.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("row")).select("doc_id", "text", "row.*")
    else:
        rest = rest.distinct()
    return asked.where("not may").select(names).union(rest.select(names)).toDF(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such go.

    Null and empty texts hold none; repeated rows are cut alike; a very long
    text is read whole, in blocks. An empty table stays empty, and an empty
    benchmark changes nothing.
    """
    return with_length(contamination.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def packed_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``bin_id, doc_id, piece, start, n_tokens``: where each document's words lie; here words are the tokens.

    Null and empty texts come out with a null bin; a text longer than a bin is
    cut into pieces; repeated rows are packed one by one, ties by doc_id. An
    empty table gives no bins; other columns are not read.
    """
    return packing.pack(packing.packable(docs))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", repeated_lines),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", packed_bins),
]

#: SQL can't express the fitted classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before = docs
        with temporary() as keep:
            docs = keep(written(stage(spark, docs, sf_dir), f"stage-{k}"))
        if k:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)

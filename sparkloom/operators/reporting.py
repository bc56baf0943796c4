"""The data set as a whole: its mode, whether it may be exported, its review sample and report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import curation
from sparkloom.sources import files
from sparkloom.sources.staging import staged

# Fixed values.
MODES = {
    "single_document": ("Single-document", "Dataset exportado sin eval limpio por doc_id.", "Apto para entrenamiento / no apto como benchmark serio"),
    "multi_document": ("Multi-document", "Dataset exportado con eval limpio por doc_id.", "Apto para entrenamiento y evaluacion por documento"),
}
NO_TRAIN = "No hay ejemplos de train curados para exportar."
NO_EVAL = "No se puede exportar sin un eval no vacio. Agrega mas PDFs o habilita generate_eval."


def dataset_mode(manifest: DataFrame) -> DataFrame:
    """One row: ``mode, label, note, aptitude, documents, clean_eval`` of ``manifest(doc_id, split)``."""
    one = manifest.agg(F.count_distinct("doc_id").alias("documents"), (F.count_if(F.col("split") == "eval") > 0).alias("has_eval"))
    single = F.col("documents") == 1
    named = [F.when(single, MODES["single_document"][k]).otherwise(MODES["multi_document"][k]).alias(n) for k, n in enumerate(("label", "note", "aptitude"))]
    return one.select(F.when(single, "single_document").otherwise("multi_document").alias("mode"), *named, "documents", (~single & F.col("has_eval")).alias("clean_eval"))


# Fixed values.
NO_SOURCES = "No se encontraron PDFs elegibles en la carpeta indicada."


def source_mode(files: DataFrame) -> DataFrame:
    """One row about the files to read: ``ok, pdf_count, mode, label, note``; or why there is nothing to do."""
    n = files.agg(F.count("*").alias("pdf_count"))
    single, some = F.col("pdf_count") == 1, F.col("pdf_count") > 0
    said = lambda k: F.when(single, MODES["single_document"][k]).when(some, MODES["multi_document"][k])
    return n.select(
        some.alias("ok"), "pdf_count", F.when(single, "single_document").when(some, "multi_document").alias("mode"), said(0).alias("label"), F.coalesce(said(1), F.lit(NO_SOURCES)).alias("note"))


def export(curated: DataFrame, mode: DataFrame, folder: str, review_size: int = 100, require_eval: bool = True, allow_partial: bool = False) -> dict[str, int]:
    """Writes ``train``, with a clean eval ``eval`` (else an old one goes), and the review sample as JSON lines and CSV; returns the counts.

    Raises what :func:`export_guard` finds.
    """
    # written once: the guard, each split and the sample read it
    curated, mode = staged(curated, "export"), staged(mode, "export-mode")
    error = export_guard(curated, mode, require_eval, allow_partial).first()["error"]
    if error:
        raise RuntimeError(error)
    kept, clean = curated.where("reason is null"), mode.first()["clean_eval"]
    counts = {}
    for split in ("train", "eval"):
        rows, path = kept.where(F.col("split") == split), f"{folder}/{split}.jsonl"
        if split == "train" or clean:
            files.write_jsonl(curation.training_records(rows).drop("example_ord"), path)
            counts[split] = rows.count()
        else:
            files.remove(curated.sparkSession, path)
            counts[split] = 0
    sample = review_fill(kept if clean else kept.where("split = 'train'"), review_size)
    files.write_jsonl(sample, f"{folder}/review_sample.jsonl")
    files.write_csv(sample, f"{folder}/review_sample.csv")
    return counts | {"review": sample.count()}


def reexport(curated: DataFrame, folder: str, review_size: int = 100) -> dict[str, int]:
    """The files of :func:`export` after edits: both splits, files of empty ones go, and the review sample is train's only."""
    counts, spark = {}, curated.sparkSession
    kept = staged(curated.where("reason is null"), "export")
    for split in ("train", "eval"):
        rows = kept.where(F.col("split") == split)
        counts[split] = rows.count()
        if counts[split]:
            files.write_jsonl(curation.training_records(rows).drop("example_ord"), f"{folder}/{split}.jsonl")
        else:
            files.remove(spark, f"{folder}/{split}.jsonl")
    sample = review_fill(kept.where("split = 'train'"), review_size)
    counts["review"] = sample.count()
    for name, write in (("review_sample.jsonl", files.write_jsonl), ("review_sample.csv", files.write_csv)):
        if counts["review"]:
            write(sample, f"{folder}/{name}")
        else:
            files.remove(spark, f"{folder}/{name}")
    return counts


def export_guard(curated: DataFrame, mode: DataFrame, require_eval: bool = True, allow_partial: bool = False) -> DataFrame:
    """One row, ``error``: why the data set may not be exported, or null."""
    counts = curated.where("reason is null").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "eval").alias("eval"))
    none = F.lit(None).cast("boolean")
    facts = counts.select("train", "eval", none.alias("single"), none.alias("clean")).union(mode.select(F.lit(None), F.lit(None), F.col("mode") == "single_document", "clean_eval"))
    facts = facts.agg(*[F.max(x).alias(x) for x in facts.columns])
    lacks = F.lit(require_eval and not allow_partial) & ~F.col("single") & (~F.col("clean") | (F.col("eval") == 0))
    return facts.select(F.when(F.col("train") == 0, NO_TRAIN).when(lacks, NO_EVAL).alias("error"))


def review_fill(accepted: DataFrame, size: int = 100) -> DataFrame:
    """The review sample of train, filled up from eval: one top-k."""
    rows = accepted.withColumn("quality_score", F.coalesce("overall", F.lit(0.0)))
    first = (F.col("split") != "train").cast("int")
    return rows.orderBy(first, "question_type", "quality_score", "example_id", "example_ord").limit(max(1, size)).select(
        "example_ord", "example_id", T.question_type(F.col("question_type")).alias("question_type"), "quality_score", "split")


def report(curated: DataFrame, mode: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``part, ord, line``: the Markdown report in order of both; built from aggregates only."""
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    c, row = F.col, lambda part, ord_, line: F.struct((ord_ if part else F.lit(ord_)).alias("ord"), line.alias("line"), F.lit(part).alias("part"))
    shown = lambda df, *rows: df.select(F.explode(F.array(*rows)).alias("r")).select("r.part", "r.ord", "r.line")
    clean = text("- Eval limpio por doc_id: ", F.when(c("clean_eval"), "si").otherwise("no"))
    head = shown(mode, row(0, "0", text("- Modo: ", c("label"))), row(0, "3", clean), row(0, "4", text("- Aptitud: ", c("aptitude"))))
    for k, name, df in (("1", "Documentos", documents), ("2", "Chunks", chunks)):
        head = head.union(shown(df.agg(F.count("*").alias("n")), row(0, k, text(f"- {name}: ", c("n")))))
    # a handful of reasons in each split
    counts = curated.groupBy("split", "reason").agg(F.count("*").alias("n"))
    per = counts.groupBy("split").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(c("reason").isNull(), c("n"))), F.lit(0)).alias("ok"), F.collect_list(F.when(c("reason").isNotNull(), F.struct("reason", "n"))).alias("why"))
    why = F.transform("why", lambda r: row(2, F.concat_ws("/", c("split"), r["reason"]), text("  - ", r["reason"], ": ", r["n"])))
    kept = text("- ", c("split"), ": accepted=", c("ok"), " rejected=", c("n") - c("ok"), " total=", c("n"))
    lines = F.concat(F.array(row(1, c("split"), text("- ", c("split"), ": ", c("n"))), row(2, c("split"), kept)), why)
    return head.union(per.select(F.explode(lines).alias("r")).select("r.part", "r.ord", "r.line"))

"""From files or raw page texts to documents: extraction with a fallback, OCR, page assets, formulas, sections."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import maths
from sparkloom.functions import text as T
from sparkloom.functions.frames import once
from sparkloom.operators import chunking, semantic
from sparkloom.sources import files
from sparkloom.sources.staging import staged
from sparkloom.sources.tables import LINES_PER_PAGE

LEAST_CHARS = 80


class PageExtractor(Protocol):
    """Reads a file's pages; made on the driver, pickled to the tasks. Raises what it can't read."""

    name: str

    def pages(self, content: bytes) -> list[str]: ...


class PlainText:
    """Pages of UTF-8 text, parted by form feeds."""

    name = "plain"

    def pages(self, content: bytes) -> list[str]:
        return content.decode("utf-8").split("\f")


def extracted(files: DataFrame, extractors: Sequence[PageExtractor]) -> DataFrame:
    """``path, pages, parser, error`` of ``files(path, content)``: the pages of the first extractor that reads a file.

    Where none does, pages and parser are null and error says why the last one
    failed; one bad file stops no other.
    """
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                error = "no extractor"
                for e in extractors:
                    try:
                        out.append((path, e.pages(content), e.name, None))
                        break
                    except Exception as x:  # whatever a parser raises, the next one is tried
                        error = f"{e.name}: {x}"
                else:
                    out.append((path, None, None, error))
            yield pd.DataFrame(out, columns=["path", "pages", "parser", "error"])

    return files.select("path", "content").mapInPandas(read, "path string, pages array<string>, parser string, error string")


def skip_reason(pages: Column, free_mb: Column, max_pages: int | None, max_ram_mb: int | None) -> Column:
    """Why a costly parser is left out, by the setting's name: too many pages, or too little memory; a limit of None is none."""
    reason = F.lit(None).cast("string")
    if max_ram_mb is not None:
        reason = F.when(free_mb < max_ram_mb, "docling_max_ram_mb").otherwise(reason)
    if max_pages is not None:
        reason = F.when(pages > max_pages, "docling_max_pages").otherwise(reason)
    return reason


def read_pages(pages: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """``pages(raw_text, ocr_text, has_images, ...)`` with ``page_text, ocr_used, visual, requires_multimodal``.

    The normalised text; where that has under ``least`` characters, that of the
    OCR if it is longer. A page needs its image where it shows something, was
    read by OCR, or has little text.
    """
    own, ocr = T.normalize_text(F.coalesce("raw_text", F.lit(""))), T.normalize_text(F.coalesce("ocr_text", F.lit("")))
    rows = pages.withColumns({"own_": own, "ocr_": ocr})
    used = (F.length("own_") < least) & (F.length("ocr_") > F.length("own_"))
    rows = rows.withColumns({"ocr_used": used, "page_text": F.when(used, F.col("ocr_")).otherwise(F.col("own_"))}).drop("own_", "ocr_")
    visual = F.coalesce("has_images", F.lit(False)) | T.has_any(F.coalesce("raw_text", F.lit("")), T.FORMULA_MARKERS)
    return rows.withColumn("visual", visual).withColumn("requires_multimodal", F.col("visual") | F.col("ocr_used") | (F.length("page_text") < least))


def marked_pages(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page_no, page_text)`` with formulas marked and ``expressions``, their number; pages without any stay as they are."""
    rows = maths.with_lines(pages.where("page_text is not null"), "page_text", "lines_")
    rows = rows.withColumn("expressions", maths.formulas(F.col("lines_")))
    return rows.withColumn("page_text", F.when(F.col("expressions") > 0, maths.mark(F.col("lines_"))).otherwise(F.col("page_text"))).drop("lines_")


def with_assets(paged: DataFrame) -> DataFrame:
    """``paged(doc_id, pages)`` with ``assets``: number, path, need of the image, and OCR of each page."""
    asset = F.transform("pages", lambda p, i: F.struct(
        (i + 1).cast("long").alias("page_number"), (T.has_any(p, T.FORMULA_MARKERS) | (F.length(p) < LEAST_CHARS)).alias("requires_multimodal"), F.lit(False).alias("ocr_used")))
    image = lambda a: F.when(a["requires_multimodal"], F.format_string("pages/%s/page-%04d.png", F.col("doc_id").cast("string"), a["page_number"]))
    return paged.withColumn("assets", F.transform(asset, lambda a: F.struct(a["page_number"], image(a).alias("image_path"), a["requires_multimodal"], a["ocr_used"])))


def ingested(documents: DataFrame, paged: DataFrame) -> DataFrame:
    """``doc_id, source, text, pages, sections, assets``: what :func:`sparkloom.operators.chunking.document_chunks` reads."""
    rows = semantic.section_arrays(documents.select("doc_id", "source", "text").where("text is not null"))
    return with_assets(rows.join(paged.select("doc_id", "pages"), "doc_id"))


def ingest_folder(
    spark: SparkSession, folder: str, extractors: Sequence[PageExtractor], pattern: str = "*.pdf", limit: int | None = None, target: int = 8192, overlap: int = 200,
    strategy: str = "semantic", max_pages: int | None = None, language: str = "es", detector: Callable[[str], str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of the files under a folder, the first ``limit`` by path.

    Documents have ``doc_id, source, source_doc, text, pages, sections, assets,
    parser, error, language, math_expressions``. A file that no extractor reads
    is a document without pages. Contents are read by the tasks that extract them.
    """
    paths = files.discover(spark, folder, limit=limit, pattern=pattern).select("path")
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    read = staged(extracted(contents.join(paths, "path", "left_semi"), extractors), "extracted")
    rows = read.select("path", F.posexplode("pages").alias("page_no", "raw_text")).withColumns({"ocr_text": F.lit(None).cast("string"), "has_images": F.lit(False)})
    marked = marked_pages(read_pages(rows).select("path", "page_no", "page_text", "requires_multimodal", "ocr_used"))
    asset = F.struct("page_no", "page_text", "expressions", "requires_multimodal", "ocr_used")
    per = marked.groupBy("path").agg(F.array_sort(F.collect_list(asset)).alias("p"))
    docs = read.select("path", "parser", "error").join(per, "path", "left")
    pages = F.coalesce(F.transform("p", lambda x: x["page_text"]), F.array().cast("array<string>"))
    docs = once(docs, pages=pages).withColumns({"doc_id": files.document_name(F.col("path")), "source_doc": F.element_at(F.split("path", "/"), -1), "source": F.lit(folder)})
    body = F.array_join(F.filter("pages", lambda x: x != ""), "\n\n")
    docs = docs.withColumns({
        "math_expressions": F.coalesce(F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["expressions"]), F.lit(0)), "language": T.language(body, language, detector=detector),
        "assets": F.coalesce(F.transform("p", lambda x: F.struct((x["page_no"] + 1).cast("long").alias("page_number"), F.lit(None).cast("string").alias("image_path"), x["requires_multimodal"], x["ocr_used"])), F.array().cast("array<struct<page_number:bigint,image_path:string,requires_multimodal:boolean,ocr_used:boolean>>")),
        # a page is one line here, followed by as many as make up a page
        "text": F.array_join(F.transform("pages", lambda x: F.concat(x, F.lit("\n" * (LINES_PER_PAGE - 1)))), "\n"),
    })
    columns = ["doc_id", "source", "source_doc", "text", "pages", "sections", "assets", "parser", "error", "language", "math_expressions"]
    documents = staged(semantic.section_arrays(docs).select(*columns), "documents")
    chunks = chunking.document_chunks(documents.where(F.size("pages") > 0), target, overlap, strategy, max_pages)
    near = chunking.lexical_neighbors(chunks.select("doc_id", "chunk_id", "chunk_ord", "text"))
    return documents, chunks.drop("neighbors").join(near, "chunk_id")

"""Chunks of paged documents. Everything is cut from a document's own arrays, so nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import text as T
from sparkloom.functions.frames import once
from sparkloom.functions.packing import windows
from sparkloom.operators import semantic
from sparkloom.operators.ranking import PART, SEAT, ranged
from sparkloom.sources.staging import staged

# Fixed values.
STRATEGIES = ("semantic", "headings_first")
LOW_COVERAGE = 0.15
_WORD = re.compile(r"[^ \t\r\n]+")


def window_starts(count: Column, target: int, overlap: int) -> Column:
    """Where windows of ``target`` items start, from 0, each ``target - overlap`` after the last; none for no items."""
    step = max(target - overlap, 1)
    windows = F.when(count <= target, 1).otherwise(1 + F.ceil((count - target) / step)).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), windows - 1), lambda k: k * step)).otherwise(F.array().cast("array<int>"))


def word_windows(documents: DataFrame, target: int = 128, overlap: int = 16) -> DataFrame:
    """``doc_id, chunk_ord, n_words, text_hash``: windows of ``target`` words, each
    starting ``target - overlap`` after the last; one window if the words fit in one."""
    rows = once(documents.select("doc_id", "text"), w=T.words(F.col("text")))
    # the windows are cut in the row, so that no row carries all words along
    parts = F.transform(window_starts(F.size("w"), target, overlap), lambda a: F.slice("w", a + 1, F.lit(target)))
    cut = rows.select("doc_id", F.posexplode(parts).alias("chunk_ord", "part"))
    return cut.select("doc_id", F.col("chunk_ord").cast("long").alias("chunk_ord"), F.size("part").cast("long").alias("n_words"), F.sha1(F.array_join("part", " ")).alias("text_hash"))


class Tokenizer(Protocol):
    """Tokens of a text; made in each task by a function that is sent there."""

    def ends(self, text: str) -> list[int]:
        """Where each token ends, in characters, in order."""
        ...


class PieceTokens:
    """Tokens without a vocabulary: runs of ``size`` characters within words."""

    def __init__(self, size: int = 4):
        self.size = size

    def ends(self, text: str) -> list[int]:
        return [e for m in _WORD.finditer(text) for e in (*range(m.start() + self.size, m.end(), self.size), m.end())]


def _tokens_by_word(texts: pa.Array, tokenizer: Tokenizer) -> pa.Array:
    """Per text the tokens that begin before the end of each of its words, so far."""
    out = []
    for text in texts.to_pylist():
        ends = np.array([m.end() for m in _WORD.finditer(text or "")], np.int64)
        starts = np.concatenate([[0], np.array(tokenizer.ends(text), np.int64)])[:-1] if len(ends) else ends
        out.append(np.searchsorted(starts, ends, side="left"))
    return pa.array(out, pa.list_(pa.int64()))


def tokens_by_word(text: Column, make: Callable[[], Tokenizer]) -> Column:
    """Cumulative token counts by word (white space parts words); the tokenizer is called once for a text."""

    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = make()
        for batch in batches:
            yield _tokens_by_word(batch, tokenizer)

    return F.arrow_udf(counts, "array<bigint>")(text)


def token_counter(make: Callable[[], Tokenizer]) -> Callable[[Column], Column]:
    """A measure of an array of texts: the tokens of each."""

    def of(texts: Column) -> Column:
        def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokenizer = make()
            for batch in batches:
                yield pa.array([None if row is None else [len(tokenizer.ends(t)) for t in row] for row in batch.to_pylist()], pa.list_(pa.int64()))

        return F.arrow_udf(counts, "array<bigint>")(texts)

    return of


def token_windows(documents: DataFrame, make: Callable[[], Tokenizer], target: int = 128, overlap: int = 16) -> DataFrame:
    """``doc_id, chunk_ord, n_words, n_tokens, text``: windows of at most ``target`` tokens of a tokenizer, whole words, one at least.

    Neighbours share the words that hold at most ``overlap`` tokens. A text is
    tokenized once; a window's tokens are those of the whole text in it.
    """
    rows = once(documents.select("doc_id", "text"), sums=tokens_by_word(F.coalesce("text", F.lit("")), make))
    rows = once(rows, spans=windows(F.col("sums"), target, overlap), w=T.words(F.coalesce("text", F.lit(""))))
    part = F.transform("spans", lambda s: F.struct(
        (s["end"] - s["start"]).cast("long").alias("n_words"), (F.col("sums")[s["end"] - 1] - F.when(s["start"] > 0, F.get("sums", s["start"] - 1)).otherwise(0)).alias("n_tokens"),
        F.array_join(F.slice("w", s["start"] + 1, s["end"] - s["start"]), " ").alias("text")))
    return rows.select("doc_id", F.posexplode(part).alias("chunk_ord", "c")).select("doc_id", F.col("chunk_ord").cast("long").alias("chunk_ord"), "c.*")


def strategy_of(name: str | None = None, use_semantic: bool | None = None) -> str:
    """A chunking strategy by its name; an unknown one is semantic. The flag counts where no name is given."""
    if name:
        plain = name.strip().lower()
        return plain if plain in STRATEGIES else "semantic"
    return "headings_first" if use_semantic is False else "semantic"


def expected_chunks(pages: Column, density: int = 20) -> Column:
    return F.when(pages <= 1, 1).otherwise(F.greatest(F.lit(2), F.ceil(pages / density))).cast("long")


def document_ref(doc_id: str = "doc_id") -> Column:
    return F.concat(F.lit("doc-"), F.col(doc_id).cast("string"))


PARTS = ("doc_id", "chunk_id", "chunk_ord", "heading", "page_start", "page_end", "text", "split_reason", "parent_chunk_id", "split_part")


def plain_chunks(documents: DataFrame, target: int, overlap: int) -> DataFrame:
    """Word windows over each of a document's ``sections``, or over all its ``pages`` if it has none; rows of PARTS."""
    section = F.transform("sections", lambda s: F.struct(s["heading"].alias("heading"), s["page_start"].alias("a"), s["page_end"].alias("b"), T.words(s["text"]).alias("w")))
    docs = once(documents.select("doc_id", "pages", "sections"), given=section)
    of_sections = F.flatten(F.transform("given", lambda s: F.transform(
        F.when(F.size(s["w"]) == 0, F.array(F.lit(0))).otherwise(window_starts(F.size(s["w"]), target, overlap)),
        lambda k: F.struct(s["heading"].alias("heading"), s["a"].cast("long").alias("page_start"), s["b"].cast("long").alias("page_end"), F.array_join(F.slice(s["w"], k + 1, F.lit(target)), " ").alias("text")),
    )))
    paged = F.flatten(F.transform("pages", lambda p, i: F.transform(T.words(p), lambda w: F.struct(w.alias("w"), (i + 1).cast("long").alias("page")))))
    docs = once(docs, words=F.when(F.size("sections") == 0, paged).otherwise(F.array().cast("array<struct<w:string,page:bigint>>")))
    of_pages = F.transform(window_starts(F.size("words"), target, overlap), lambda k: F.struct(
        F.lit("").alias("heading"), F.try_element_at("words", k + 1)["page"].alias("page_start"), F.element_at(F.slice("words", k + 1, F.lit(target)), -1)["page"].alias("page_end"),
        F.array_join(F.transform(F.slice("words", k + 1, F.lit(target)), lambda x: x["w"]), " ").alias("text"),
    ))
    cut = docs.select("doc_id", F.posexplode(F.when(F.size("sections") > 0, of_sections).otherwise(of_pages)).alias("k", "c")).select("doc_id", "k", "c.*")
    name = F.concat(document_ref(), F.format_string("-chunk-%04d-", F.col("k") + 1), F.substring(F.sha1("text"), 1, 10))
    none = [F.lit(None).cast(t).alias(n) for n, t in zip(PARTS[-3:], ("string", "string", "long"), strict=True)]
    return cut.select("doc_id", name.alias("chunk_id"), F.col("k").cast("long").alias("chunk_ord"), "heading", "page_start", "page_end", "text", *none)


def page_parts(first: Column, last: Column, width: Column) -> Column:
    """Windows of ``width`` pages of the array ``pages`` from page ``first`` to ``last``; those without text are left out."""
    return F.filter(F.transform(F.sequence(first, last, width), lambda a: F.struct(
        a.cast("long").alias("page_start"), F.least(a + width - 1, last).cast("long").alias("page_end"),
        F.array_join(F.filter(F.slice("pages", a.cast("int"), F.least(width, last - a + 1).cast("int")), lambda p: p != ""), "\n\n").alias("text"),
    )), lambda c: c["text"] != "")


def limited_pages(chunks: DataFrame, documents: DataFrame, most: int | None) -> DataFrame:
    """``chunks`` (PARTS), those of over ``most`` pages cut into page windows of their document; one whose pages hold no text stays whole."""
    if most is None or most <= 0:
        return chunks
    wide = F.col("page_end") - F.col("page_start") + 1 > most
    cut = chunks.where(wide).join(documents.where(F.size("pages") > 0).select("doc_id", "pages"), "doc_id", "left")
    first, last = F.greatest("page_start", F.lit(1)), F.least("page_end", F.size("pages").cast("long"))
    parts = F.when(F.col("pages").isNotNull() & (first <= last), page_parts(first, last, F.lit(most).cast("long")))
    cut = cut.withColumn("parts", parts).drop("pages").select(*PARTS, F.posexplode_outer("parts").alias("k", "p"))
    own = lambda name, new: F.when(F.col("p").isNull(), F.col(name)).otherwise(new).alias(name)
    suffix = F.format_string("-p%04d-%04d", "p.page_start", "p.page_end")
    cut = cut.select(
        "doc_id", own("chunk_id", F.concat("chunk_id", suffix)), "chunk_ord", "heading", own("page_start", F.col("p.page_start")), own("page_end", F.col("p.page_end")),
        own("text", F.col("p.text")), own("split_reason", F.lit("max_pages_per_chunk")), own("parent_chunk_id", F.col("chunk_id")), own("split_part", (F.col("k") + 1).cast("long")),
    )
    return chunks.where(~wide).select(*PARTS).union(cut)


def document_chunks(documents: DataFrame, target: int = 8192, overlap: int = 200, strategy: str = "semantic", max_pages: int | None = None, density: int = 20) -> DataFrame:
    """Chunks of ``documents(doc_id, source, text, pages, sections, assets)`` with neighbours, page assets and coverage.

    Sections given (more than one) or else the headings in the text make the
    chunks; where those leave out too much of a document without sections, or
    with the other strategy, word windows do. Chunks of over ``max_pages`` are
    cut by pages. Documents without sections that give too few chunks for their
    pages are cut into page windows instead. All steps go by doc_id.
    """
    narrow = documents.select("doc_id", "source", "text", "sections")
    given = F.transform("sections", lambda s: F.struct(
        s["heading"].alias("heading"), s["page_start"].cast("int").alias("page_start"), s["page_end"].cast("int").alias("page_end"), s["text"].alias("text"), T.word_count(s["text"]).alias("tokens")))
    several = F.size("sections") > 1
    heads = narrow.where(several).select("doc_id", "source", given.alias("chapters")).union(semantic.chapters(semantic.tree(narrow.where(~several))).select("doc_id", "source", "chapters"))
    smart = semantic.overlapped(semantic.split_sections(semantic.merged_sections(heads, target // 2), target), overlap)
    none = [F.lit(None).cast(t).alias(n) for n, t in zip(PARTS[-3:], ("string", "string", "long"), strict=True)]
    # written, as the headings are costly to find and are read twice
    smart = staged(smart.select(*PARTS[:-3], *none), "semantic-chunks")
    n_pages, words = F.size("pages").cast("long"), F.aggregate("pages", F.lit(0).cast("long"), lambda n, p: n + T.word_count(p))
    facts = documents.select("doc_id", n_pages.alias("page_count"), words.alias("words"), (F.size("sections") > 0).alias("has_sections"))
    seen = smart.groupBy("doc_id").agg(F.count("*").alias("n"), F.max_by("page_end", "chunk_ord").alias("last"))
    facts = facts.join(seen, "doc_id", "left")
    stride = max(1, target - max(0, overlap))
    few = F.when(F.col("n").isNull(), True).when(F.col("has_sections") | (F.col("page_count") <= 1), False).when(F.col("last") < F.col("page_count"), True).when(
        F.col("words") > target, (F.col("n") == 1) | (F.col("n") < 1 + F.ceil((F.col("words") - target) / stride))).otherwise(False)
    facts = facts.select("doc_id", "page_count", "has_sections", (few if strategy == "semantic" else F.lit(True)).alias("plain"))
    plain = plain_chunks(documents.join(facts.where("plain").select("doc_id"), "doc_id", "left_semi"), target, overlap)
    rows = smart.join(facts.where("not plain").select("doc_id"), "doc_id", "left_semi").select(*PARTS).union(plain.select(*PARTS))
    rows = staged(limited_pages(rows, documents, max_pages), "limited-chunks")
    # documents without sections whose chunks are too few
    n = F.count("*").over(Window.partitionBy("doc_id"))
    rows = rows.join(facts.drop("plain"), "doc_id").withColumn("sparse", ~F.col("has_sections") & (F.col("page_count") > 0) & (n < expected_chunks(F.col("page_count"), density)))
    sparse = documents.join(rows.where("sparse").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "pages")
    width = F.greatest(F.lit(1).cast("long"), F.floor(n_pages / expected_chunks(n_pages, density)).cast("long"))
    dense = sparse.select("doc_id", n_pages.alias("page_count"), F.posexplode(page_parts(F.lit(1).cast("long"), n_pages, width)).alias("k", "p")).select("doc_id", "page_count", "k", "p.*")
    digest = F.substring(F.sha1(F.concat_ws("-", document_ref(), F.lit("min_chunk_density"), F.col("page_start").cast("string"), F.col("page_end").cast("string"), F.col("text"))), 1, 12)
    dense = dense.select(
        "doc_id", F.concat(document_ref(), F.format_string("-chunk-%04d-", F.col("k") + 1), digest).alias("chunk_id"), F.col("k").cast("long").alias("chunk_ord"), F.lit("").alias("heading"), "page_start", "page_end", "text",
        F.lit("min_chunk_density").alias("split_reason"), F.lit(None).cast("string").alias("parent_chunk_id"), (F.col("k") + 1).cast("long").alias("split_part"), "page_count",
    )
    rows = rows.where("not sparse").select(*PARTS, "page_count").union(dense)
    return _annotated(rows, documents, strategy, density)


def _annotated(rows: DataFrame, documents: DataFrame, strategy: str, density: int) -> DataFrame:
    """Chunks in order with their neighbours, the assets of their pages, and their document's coverage."""
    order, whole = Window.partitionBy("doc_id").orderBy("chunk_ord", "split_part"), Window.partitionBy("doc_id")
    # the furthest page before a chunk: ranges start no earlier than those before them where pages are in order
    a, b = F.greatest("page_start", F.lit(1)), F.greatest("page_start", "page_end")
    covered = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(a, b)).over(whole)))).cast("long")
    rows = rows.withColumns({
        "ord": (F.row_number().over(order) - 1).cast("long"), "neighbors": F.filter(F.array(F.lag("chunk_id").over(order), F.lead("chunk_id").over(order)), lambda x: x.isNotNull()),
        "chunk_count": F.count("*").over(whole), "pages_covered": covered,
    })
    rows = rows.join(documents.select("doc_id", "source", "assets"), "doc_id")
    inside = F.filter("assets", lambda x: (x["page_number"] >= F.col("page_start")) & (x["page_number"] <= F.col("page_end")))
    ratio, least = F.bround(F.col("pages_covered") / F.greatest(F.col("page_count"), F.lit(1)), 4), expected_chunks(F.col("page_count"), density)
    return once(rows, inside=inside).select(
        "doc_id", "source", "chunk_id", F.col("ord").alias("chunk_ord"), "heading", "page_start", "page_end", T.word_count(F.col("text")).alias("n_words"), "text", "neighbors",
        F.filter(F.transform("inside", lambda x: x["image_path"]), lambda x: x.isNotNull()).alias("page_image_paths"), F.exists("inside", lambda x: x["requires_multimodal"]).alias("requires_multimodal"),
        F.exists("inside", lambda x: x["ocr_used"]).alias("uses_ocr"), "split_reason", "parent_chunk_id", "split_part", (F.col("split_reason") == "min_chunk_density").alias("low_chunk_density_fallback"),
        "page_count", "pages_covered", ratio.alias("coverage_ratio"), "chunk_count", least.alias("expected_min_chunks"), F.lit(strategy).alias("chunking_strategy"),
        ((ratio < LOW_COVERAGE) | (F.col("chunk_count") < least)).alias("low_coverage"),
    )


def page_windows(paged: DataFrame, max_pages: int = 4) -> DataFrame:
    """``doc_id, source, chunk_ord, page_start, page_end, text`` for ``paged(doc_id, source, pages)``.

    Windows of ``max_pages`` pages; those without text are skipped, and the
    ordinals count what is left.
    """
    starts = F.sequence(F.lit(1), F.size("pages"), F.lit(max_pages))
    chunks = F.transform(starts, lambda s: F.struct(
        s.alias("page_start"), F.least(s + (max_pages - 1), F.size("pages")).alias("page_end"),
        F.array_join(F.filter(F.slice("pages", s, F.lit(max_pages)), lambda p: p != ""), "\n\n").alias("text"),
    ))
    full = paged.where(F.size("pages") > 0).withColumn("chunks", F.filter(chunks, lambda c: c["text"] != ""))
    return full.select("doc_id", "source", F.posexplode("chunks").alias("chunk_ord", "c")).select("doc_id", "source", F.col("chunk_ord").cast("long").alias("chunk_ord"), "c.page_start", "c.page_end", "c.text")


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Adds ``chunk_id``: document, ordinal, and a digest of both and the first page."""
    doc = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    digest = F.substring(F.sha1(F.concat_ws("-", doc, F.col("chunk_ord").cast("string"), F.col("page_start").cast("string"))), 1, 12)
    return chunks.withColumn("chunk_id", F.concat(doc, F.format_string("-chunk-%04d-", "chunk_ord"), digest))


def coverage(paged: DataFrame, max_pages: int = 4, density: int = 20) -> DataFrame:
    """Per document of ``paged(doc_id, pages)``: pages, pages in some window of ``max_pages``, their ratio, windows, and the least number expected.

    A document's windows are in its own row, so nothing is shuffled.
    """
    n = F.size("pages").cast("long")
    rows = once(paged.select("doc_id", "pages"), parts=F.when(n > 0, page_parts(F.lit(1).cast("long"), n, F.lit(max_pages).cast("long"))))
    covered = F.aggregate("parts", F.lit(0).cast("long"), lambda total, p: total + p["page_end"] - p["page_start"] + 1)
    return rows.select(
        "doc_id", n.alias("page_count"), F.coalesce(covered, F.lit(0)).alias("pages_covered"), F.bround(F.coalesce(covered, F.lit(0)) / F.greatest(n, F.lit(1)), 4).alias("coverage_ratio"),
        F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("chunk_count"), expected_chunks(n, density).alias("expected_min_chunks"),
    )


def lexical_neighbors(chunks: DataFrame, most: int = 2) -> DataFrame:
    """``chunk_id, neighbors``: the chunks before and after; the first and the last of a document get the earliest others that share a word, up to ``most``.

    One shuffle, by document; only the end chunks' words meet those of the rest.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_ord")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = chunks.select("doc_id", "chunk_id", "chunk_ord", F.explode(F.array(T.token_set(F.col("text")))).alias("words"))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(whole))
    rows = rows.withColumns({"head": F.first("words").over(whole), "tail": F.last("words").over(whole), "before": F.lag("chunk_id").over(order), "after": F.lead("chunk_id").over(order)})
    hit = lambda end, far: F.when(far & F.arrays_overlap("words", end), F.struct("place", "chunk_id"))
    rows = rows.withColumn("to_head", hit("head", F.col("place") > 2)).withColumn("to_tail", hit("tail", F.col("place") < F.col("n") - 1))
    rows = rows.withColumns({"for_head": F.min("to_head").over(whole), "for_tail": F.min("to_tail").over(whole)})
    extra = F.when(F.col("place") == 1, F.col("for_head.chunk_id")).when(F.col("place") == F.col("n"), F.col("for_tail.chunk_id"))
    return rows.select("chunk_id", F.slice(F.filter(F.array("before", "after", extra), lambda x: x.isNotNull()), 1, min(most, 2)).alias("neighbors"))


def page_batches(chunks: DataFrame, budget: int = 100, by: str = "split", blocks: int | None = None) -> DataFrame:
    """``by, doc_id, chunk_id, batch_no``: in order, chunks of a group while their distinct pages keep to ``budget``; a larger one stands alone.

    Batches cross documents, but between two documents only the number of pages
    so far counts. So blocks of documents, sampled ranges of their ids (of any
    type that has an order), are worked through at the same time, once for each
    number of pages they could begin with; these small tables are put together
    in order, and then each block knows how it begins. Needs
    ``doc_id, chunk_id, chunk_ord, page_start, page_end``; a document's ranges
    start no earlier than those before them.
    """
    blocks = blocks or 4 * chunks.sparkSession.sparkContext.defaultParallelism
    narrow = chunks.select(by, "doc_id", "chunk_id", "chunk_ord", F.col("page_start").cast("long").alias("a"), F.col("page_end").cast("long").alias("b"))
    dealt = ranged(narrow, [by, "doc_id"], "page-order", blocks, apart=False).withColumnRenamed(PART, "block").drop(SEAT)

    def walked(docs, firsts, lasts, pages, batch):
        """Batch numbers after each chunk, for arrays of pages and batches to begin with, and how they end."""
        last, doc = np.zeros_like(pages), None
        for d, a, b in zip(docs, firsts, lasts, strict=True):
            if d != doc:
                doc, last = d, np.zeros_like(pages)
            more = np.maximum(b - np.maximum(a - 1, last), 0)
            new = (pages > 0) & (pages + more > budget)
            batch = batch + new
            pages = np.where(new, b - a + 1, pages + more)
            last = np.maximum(np.where(new, 0, last), b)
            yield pages, batch

    def table(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "chunk_ord"])
        *_, (pages, batch) = walked(part["doc_id"], part["a"], part["b"], np.arange(budget + 1), np.zeros(budget + 1, np.int64))
        return pd.DataFrame({by: part[by].iloc[:1], "block": part["block"].iloc[:1], "pages": [np.minimum(pages, budget)], "batches": [batch]})

    def begun(part: pd.DataFrame) -> pd.DataFrame:
        part, pages, batch, out = part.sort_values("block"), 0, 0, []
        for block, after, batches in zip(part["block"], part["pages"], part["batches"], strict=True):
            out.append((part[by].iloc[0], block, pages, batch))
            pages, batch = int(after[pages]), batch + int(batches[pages])
        return pd.DataFrame(out, columns=[by, "block", "pages", "batch"])

    def numbered(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "chunk_ord"])
        start = np.array([part["pages"].iloc[0]]), np.array([part["batch"].iloc[0]])
        numbers = [int(batch[0]) for _, batch in walked(part["doc_id"], part["a"], part["b"], *start)]
        return part[[by, "doc_id", "chunk_id"]].assign(batch_no=numbers)

    kind = narrow.schema[by].dataType.simpleString()
    tables = dealt.groupBy(by, "block").applyInPandas(table, f"{by} {kind}, block long, pages array<long>, batches array<long>")
    starts = tables.groupBy(by).applyInPandas(begun, f"{by} {kind}, block long, pages long, batch long")
    return dealt.join(starts, [by, "block"]).groupBy(by, "block").applyInPandas(numbered, narrow.select(by, "doc_id", "chunk_id").schema.add("batch_no", "long"))


def needs_fallback(chunks: DataFrame, paged: DataFrame, target: int, overlap: int) -> DataFrame:
    """``doc_id, fallback`` for documents without sections of their own: are headings' chunks too few for their words or pages?"""
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("page_end").alias("last"))
    rows = paged.select("doc_id", F.size("pages").alias("page_count"), F.aggregate("pages", F.lit(0).cast("long"), lambda n, p: n + T.word_count(p)).alias("tokens")).join(per, "doc_id", "left")
    expected = 1 + F.ceil((F.col("tokens") - target) / max(1, target - overlap))
    few = F.when(F.col("n").isNull(), True).when(F.col("page_count") <= 1, False).when(F.col("last") < F.col("page_count"), True).when(F.col("tokens") > target, (F.col("n") == 1) | (F.col("n") < expected)).otherwise(False)
    return rows.select("doc_id", few.alias("fallback"))


def dense_windows(paged: DataFrame, density: int = 20) -> DataFrame:
    """``doc_id, chunk_ord, page_start, page_end, text``: page windows short enough for the least number of chunks expected."""
    n = F.size("pages")
    least = F.when(n <= 1, 1).otherwise(F.greatest(F.lit(2), F.ceil(n / density))).cast("int")
    width = F.greatest(F.lit(1), F.floor(n / least)).cast("int")
    cut = paged.where(n > 0).select("doc_id", "pages", width.alias("width"))
    starts = F.sequence(F.lit(1), F.size("pages"), F.col("width"))
    cut = cut.select("doc_id", F.posexplode(F.filter(F.transform(starts, lambda s: F.struct(
        s.alias("page_start"), F.least(s + F.col("width") - 1, F.size("pages")).alias("page_end"), F.array_join(F.filter(F.slice("pages", s, F.col("width")), lambda p: p != ""), "\n\n").alias("text"),
    )), lambda c: c["text"] != "")).alias("chunk_ord", "c"))
    return cut.select("doc_id", F.col("chunk_ord").cast("long").alias("chunk_ord"), "c.*")

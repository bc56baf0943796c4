"""Chunks that follow a document's headings.

A document's lines, sections and parts stay arrays of its own row, so nothing
here is shuffled. Steps that later ones use more than once go through a
generator, or Spark would work them out for each use.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import headings as H
from sparkloom.functions import text as T
from sparkloom.functions.frames import once
from sparkloom.functions.packing import bounds, greedy_starts, lists
from sparkloom.sources.tables import LINES_PER_PAGE

# Fixed values.
WHOLE, IMPLIED_CHAPTER, IMPLIED_SECTION = "Documento", "Contenido", "Sección"
CONTINUED, RULE = "[Continuación del tema anterior]\n", "\n\n---\n\n"


def _page(pos: Column) -> Column:
    return F.floor(pos / LINES_PER_PAGE).cast("int") + 1


def _pages() -> Column:
    return _page(F.size("lines") - 1)


def section_arrays(documents: DataFrame) -> DataFrame:
    """``documents`` with ``sections``: what is between heading lines, as an array of ``heading, page_start, page_end, text``, with ``section_ord``.

    A section ends on the page of the next heading; those without text are
    left out. Null and empty texts have none. Only slices of a document's own
    lines are copied, not the lines for each section.
    """
    docs = once(documents, lines=F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), T.strip))
    heads = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda h: H.is_heading(h["line"]))
    first = F.struct(F.lit(-1).alias("pos"), F.lit(WHOLE).alias("line"))
    docs = once(docs, heads=F.concat(F.array(first), heads))

    def cut(h: Column, i: Column) -> Column:
        next_ = F.try_element_at("heads", i + 2)["pos"]
        body = F.slice("lines", h["pos"] + 2, F.coalesce(next_, F.size("lines")) - h["pos"] - 1)
        return F.struct(
            i.cast("long").alias("section_ord"), F.when(i == 0, WHOLE).otherwise(T.strip(F.regexp_replace(h["line"], "^[# ]+", ""))).alias("heading"),
            _page(F.greatest(h["pos"], F.lit(0))).cast("long").alias("page_start"), F.coalesce(_page(next_), _pages()).cast("long").alias("page_end"),
            T.normalize_text(F.array_join(F.filter(body, lambda x: x != ""), "\n")).alias("text"),
        )

    docs = once(docs, sections=F.transform("heads", cut))
    return docs.withColumn("sections", F.filter("sections", lambda s: s["text"] != "")).drop("lines", "heads")


def sections(documents: DataFrame) -> DataFrame:
    """``doc_id, section_ord, heading, page_start, page_end, text``: the rows of :func:`section_arrays`."""
    return section_arrays(documents.select("doc_id", "text")).select("doc_id", F.inline("sections"))


def tree(documents: DataFrame) -> DataFrame:
    """``doc_id, source, nodes``: chapters, sections and subsections in order, as an array.

    A node has ``level`` (1 to 3; 0 for a whole document without headings),
    ``heading``, ``page_start``, ``page_end``, ``text`` and ``tokens``. Level-1
    headings open a chapter, level-2 ones a section in it, level-3 ones a
    subsection in that; a missing chapter or section is implied. Subsections
    have no text: what follows one belongs to its section. A chapter with
    sections ends where the last of them ends, and a section with subsections
    where the last of those begins. Lines before the first heading are lost if
    there is one. White space is squeezed.
    """
    docs = once(documents.select("doc_id", "source", "text").where("text is not null"), lines=F.transform(F.split("text", "\n"), T.strip))
    docs = once(docs, levels=F.transform("lines", H.level))
    docs = once(docs, heads=F.filter(F.transform("levels", lambda level, i: F.struct(i.alias("pos"), level.alias("level"))), lambda h: h["level"] > 0))
    item = lambda pos, level, implied, own: F.struct(pos.alias("pos"), F.lit(level).alias("level"), F.lit(implied).alias("implied"), F.lit(own).alias("own"))

    def opened(h: Column, i: Column) -> Column:
        first, level = i == 0, h["level"]
        chapter, section = item(h["pos"], 1, True, False), item(h["pos"], 2, True, True)
        no_section = first | (F.try_element_at("heads", i)["level"] == 1)
        none = F.array().cast("array<struct<pos:int,level:int,implied:boolean,own:boolean>>")
        return F.concat(
            F.when(first & (level > 1), F.array(chapter)).otherwise(none), F.when(no_section & (level == 3), F.array(section)).otherwise(none),
            F.array(F.struct(h["pos"].alias("pos"), level.alias("level"), F.lit(False).alias("implied"), (level < 3).alias("own"))),
        )

    whole = F.array(item(F.lit(-1), 0, False, True))
    docs = once(docs, opens=F.when(F.size("heads") == 0, whole).otherwise(F.flatten(F.transform("heads", opened))))
    ints = lambda name, kind="int": F.transform("opens", lambda o: o[name].cast(kind))
    docs = once(docs, places=node_places(ints("pos"), ints("level"), ints("implied"), ints("own"), F.size("lines")))

    def node(o: Column, p: Column) -> Column:
        part = lambda name: F.slice(name, o["pos"] + 2, F.when(o["own"], p["stop"] - o["pos"] - 1).otherwise(0))
        own = F.zip_with(part("lines"), part("levels"), lambda x, level: F.when(level == 0, x))
        heading = (
            F.when(o["level"] == 0, WHOLE).when(o["implied"], F.when(o["level"] == 1, IMPLIED_CHAPTER).otherwise(IMPLIED_SECTION))
            .otherwise(H.title(F.try_element_at("lines", o["pos"] + 1)))
        )
        return F.struct(
            o["level"].alias("level"), heading.alias("heading"), p["page_start"].alias("page_start"), p["page_end"].alias("page_end"),
            T.squeeze(F.array_join(F.filter(own, lambda x: x.isNotNull()), " ")).alias("text"),
        )

    docs = once(docs.select("doc_id", "source", "lines", "levels", "opens", "places"), nodes=F.zip_with("opens", "places", node))
    counted = F.transform("nodes", lambda x: F.struct(
        x["level"].alias("level"), x["heading"].alias("heading"), x["page_start"].alias("page_start"), x["page_end"].alias("page_end"), x["text"].alias("text"), T.word_count(x["text"]).alias("tokens")))
    return once(docs.select("doc_id", "source", "nodes"), nodes_=counted).select("doc_id", "source", F.col("nodes_").alias("nodes"))


def _largest(values: np.ndarray, some: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The largest of some values in each group, -1 where there is none."""
    out = np.full(groups, -1)
    np.maximum.at(out, group[some], values[some])
    return out


def _places(pos: pa.Array, level: pa.Array, implied: pa.Array, own: pa.Array, n_lines: pa.Array) -> pa.Array:
    """Per node: the line where another node's text begins, and its first and last page; see :func:`tree`."""
    begin = bounds(pos)
    at, depth, implied_, owns = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (pos, level, implied, own))
    row, lines = np.repeat(np.arange(len(pos)), np.diff(begin)), n_lines.to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lines.max(initial=0)) + 2
    # nodes are in order, so the next owner of text is found by binary search
    key, owners = row * width + at + 1, (row * width + at + 1)[owns > 0]
    after = np.searchsorted(owners, key, side="right")
    following = owners[np.minimum(after, max(len(owners) - 1, 0))] if len(owners) else key
    there = (after < len(owners)) & (following // width == row)
    stop = np.where(there, following % width - 1, lines[row])
    start = np.maximum(at, 0) // LINES_PER_PAGE + 1
    # a node's pages go on while it is the one that text goes to, or its chapter, at a page's end
    ended = np.where(stop == lines[row], (lines[row] - 1) // LINES_PER_PAGE + 1, stop // LINES_PER_PAGE)
    # an implied node has no first page of its own until a page ends in it
    reach = np.where(depth == 3, start, np.where(ended >= start, ended, np.where(implied_ > 0, 1, start)))
    # the children of a chapter or section are the nodes up to the next of its kind
    chapter, section = np.cumsum(depth <= 1), np.cumsum(depth <= 2)
    sections = _largest(reach, depth == 2, chapter, len(at) + 1)[chapter]
    parts = _largest(reach, depth == 3, section, len(at) + 1)[section]
    last = np.where((depth <= 1) & (sections >= 0), sections, np.where((depth == 2) & (parts >= 0), parts, reach))
    found = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (stop, start, last)], names=["stop", "page_start", "page_end"])
    return lists(found, begin, pos)


def node_places(pos: Column, level: Column, implied: Column, own: Column, n_lines: Column) -> Column:
    """``stop, page_start, page_end`` of each node of :func:`tree`, for whole batches at once."""
    return F.arrow_udf(_places, "array<struct<stop:int,page_start:int,page_end:int>>")(pos, level, implied, own, n_lines)


def _group(items: str, starts: str, make) -> Column:
    """One ``make(members, k, start, next start)`` for each group."""
    return F.transform(starts, lambda a, k: make(F.slice(items, a + 1, F.coalesce(F.try_element_at(starts, k + 2), F.size(items)) - a), k, a, F.try_element_at(starts, k + 2)))


def chapters(trees: DataFrame) -> DataFrame:
    """``trees`` with ``chapters``: ``heading, page_start, page_end, text, tokens``; a chapter's text is its own and its sections', parted by an empty line."""
    docs = once(trees, heads=F.filter(F.transform("nodes", lambda x, i: F.when(x["level"] < 2, i)), lambda i: i.isNotNull()))
    return once(docs, chapters=_group("nodes", "heads", lambda own, k, a, b: F.struct(
        own[0]["heading"].alias("heading"), own[0]["page_start"].alias("page_start"), own[0]["page_end"].alias("page_end"),
        F.array_join(F.filter(F.transform(own, lambda x: x["text"]), lambda t: t != ""), "\n\n").alias("text"),
        F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + x["tokens"]).alias("tokens"),
    ))).drop("heads")


def merged_sections(docs: DataFrame, least: int) -> DataFrame:
    """``docs`` with ``merged``: its ``chapters``, in order, each joined by the next ones until it has ``least`` words.

    A last one that is still too short goes to the one before it.
    """
    docs = once(docs, found=greedy_starts(F.transform("chapters", lambda c: c["tokens"]), least, False))
    tail = F.aggregate(F.slice("chapters", F.element_at("found", -1) + 1, F.size("chapters")), F.lit(0).cast("long"), lambda n, c: n + c["tokens"])
    docs = once(docs, starts=F.when((F.size("found") > 1) & (tail < least), F.slice("found", 1, F.size("found") - 1)).otherwise(F.col("found")))
    return once(docs, merged=_group("chapters", "starts", lambda own, k, a, b: F.struct(
        F.array_join(F.transform(own, lambda c: c["heading"]), " / ").alias("heading"), own[0]["page_start"].alias("page_start"), F.element_at(own, -1)["page_end"].alias("page_end"),
        F.array_join(F.transform(own, lambda c: c["text"]), "\n\n").alias("text"), F.aggregate(own, F.lit(0).cast("long"), lambda n, c: n + c["tokens"]).alias("tokens"),
    ))).drop("found", "starts")


def with_units(rows: DataFrame, most: int) -> DataFrame:
    """``rows(text, tokens)`` with ``units``: the text if it has at most ``most`` words; else its paragraphs if there are several, else sentences if there are several, else windows of ``most`` words.

    Each kind is looked for only where the one before did not do.
    """
    full = lambda parts: F.filter(F.transform(parts, T.strip), lambda x: x != "")
    several = F.size("units") > 1
    rows = once(rows, units=F.when(F.col("tokens") > most, full(F.split("text", r"\n\s*\n"))))
    rows = once(rows, units=F.when(F.col("tokens") <= most, F.array("text")).when(several, F.col("units")).otherwise(full(F.split("text", r"(?<=[.!?。！？])\s+"))))
    rows = once(rows, words_=F.when((F.col("tokens") > most) & ~several, T.words(F.col("text"))))
    starts = F.sequence(F.lit(0), F.floor((F.size("words_") - 1) / most).cast("int"))
    windows = F.transform(starts, lambda k: F.array_join(F.slice("words_", k * most + 1, F.lit(most)), " "))
    return once(rows, units=F.when(F.col("words_").isNull(), F.col("units")).otherwise(windows)).drop("words_")


def split_sections(merged: DataFrame, most: int, count: Callable[[Column], Column] = T.word_count) -> DataFrame:
    """``doc_id, source, section_ord, part, heading, page_start, page_end, text``: sections of over ``most`` words in parts.

    Parts take units while they fit; a unit is never cut. Pages within a
    section are shared out by unit. ``count`` gives a text's size, words unless
    it is another measure, such as :func:`sparkloom.operators.chunking.token_counter` makes.
    """
    rows = merged.select("doc_id", "source", F.posexplode("merged").alias("section_ord", "s")).select("doc_id", "source", "section_ord", "s.*")
    rows = with_units(rows, most)
    rows = once(rows, starts=greedy_starts(F.transform("units", T.word_count) if count is T.word_count else count(F.col("units")), most, True))
    page = lambda a: F.col("page_start") + F.floor(a * (F.col("page_end") - F.col("page_start")) / F.size("units")).cast("int")
    return rows.select("doc_id", "source", "section_ord", F.posexplode(_group("units", "starts", lambda own, k, a, b: F.struct(
        F.when(F.size("starts") > 1, F.concat(F.col("heading"), F.lit(" (Parte "), (k + 1).cast("string"), F.lit(")"))).otherwise(F.col("heading")).alias("heading"),
        page(a).alias("page_start"), F.coalesce(page(b), F.col("page_end")).alias("page_end"), F.array_join(own, "\n\n").alias("text"),
    ))).alias("part", "p")).select("doc_id", "source", "section_ord", "part", "p.*")


def semantic_chunks(documents: DataFrame, target: int = 8192, overlap: int = 200) -> DataFrame:
    """``doc_id, source, chunk_id, chunk_ord, heading, page_start, page_end, n_words, text``.

    Chapters are merged up to half of ``target`` words and cut above it; all
    but a document's first chunk start with the last ``overlap`` words of the
    one before. The only shuffle is the one of the neighbours, by document.
    """
    parts = split_sections(merged_sections(chapters(tree(documents)), target // 2), target)
    return overlapped(parts, overlap)


def overlapped(parts: DataFrame, overlap: int) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.partitionBy("doc_id").orderBy("section_ord", "part")
    # the tail is cut before the window, so it needn't hold whole neighbours
    tails = once(parts, words_=T.words(F.col("text")))
    tail = F.array_join(F.slice("words_", F.greatest(F.size("words_") - overlap + 1, F.lit(1)), F.greatest(F.size("words_"), F.lit(1))), " ") if overlap > 0 else F.lit("")
    tails = once(tails, tail=tail).drop("words_")
    rows = tails.withColumn("chunk_ord", F.row_number().over(order) - 1).withColumn("before", F.lag("tail").over(order))
    text = F.when(F.col("before") != "", F.concat(F.lit(CONTINUED), F.col("before"), F.lit(RULE), F.col("text"))).otherwise(F.col("text"))
    doc = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    digest = F.substring(F.sha1(F.concat_ws("-", doc, F.col("chunk_ord").cast("string"), F.col("heading"))), 1, 12)
    rows = once(rows, full=text)
    return rows.select(
        "doc_id", "source", F.concat(doc, F.format_string("-chunk-%04d-", "chunk_ord"), digest).alias("chunk_id"), F.col("chunk_ord").cast("long").alias("chunk_ord"), "heading",
        F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"), T.word_count(F.col("full")).alias("n_words"), F.col("full").alias("text"),
    )

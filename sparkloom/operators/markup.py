"""Blocks of text out of HTML pages: headings with levels, paragraphs, list items, table rows, and how much of each is links.

A page is read once from front to back. Tags open and close elements on a
stack; text belongs to the block that is open, and what opens or closes a block
ends the one before. Broken markup has a defined reading: see :func:`blocks_of`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T

# Elements of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "iframe"}
UNSEEN = RAW - {"title", "textarea"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "img", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
HEADINGS = {f"h{k}": k for k in range(1, 7)}
BLOCKS = {"td", "th", "caption", "li", "title", "table"}
#: Elements that end an open one of these names, up to the nearest of the names after.
CLOSES = {
    "p": ({"p"}, {"td", "th", "li", "div", "section", "article", "body", "table"}), "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
CLOSES |= {h: (set(HEADINGS) | {"p"}, {"td", "th", "li", "div", "section", "article", "body", "table"}) for h in HEADINGS}

#: Elements in one another at most; those deeper down are not opened, their text is that of the last.
MOST_DEPTH = 512

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
BLOCK = "struct<kind:string,level:int,text:string,cells:array<string>,chars:int,link_chars:int,depth:int>"


def _tag_end(html: str, at: int) -> int:
    """Where the tag's ``>`` is; those in quotes don't count, a quote that is not closed is no quote. The page's end if there is none."""
    while at < len(html):
        c = html[at]
        if c == ">":
            return at
        if c in "\"'":
            close = html.find(c, at + 1)
            at = close if close >= 0 else at
            if close < 0:
                end = html.find(">", at)
                return end if end >= 0 else len(html)
        at += 1
    return len(html)


def tokens(html: str) -> Iterator[tuple[str, str]]:
    """``("text", t)``, ``("open", name)`` and ``("close", name)`` of a page, in order; the text of scripts and the like is left out."""
    at = 0
    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:]
            return
        m = _TAG.match(html, lt)
        if not m:
            yield "text", html[at : lt + 1]
            at = lt + 1
            continue
        if lt > at:
            yield "text", html[at:lt]
        if m[1]:
            end = html.find("-->", m.end())
            at = len(html) if end < 0 else end + 3
        elif m[2]:
            end = html.find(">", lt)
            at = len(html) if end < 0 else end + 1
        else:
            name, end = m[4].lower(), _tag_end(html, m.end())
            yield "close" if m[3] else "open", name
            at = end + 1
            if not m[3] and name in RAW and html[end - 1 : end] != "/":
                close = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(html, at)
                stop = close.start() if close else len(html)
                if name not in UNSEEN:
                    yield "text", html[at:stop]
                at = stop


class _Page:
    """The elements that are open, the text so far of the open block, and the blocks done."""

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.blocks: list[dict] = []
        self.parts: list[tuple[str, bool]] = []
        # for each open table the cells of its open row
        self.rows: list[list[tuple[str, int, int]]] = []
        # how many elements of each name are open, and what kind of block each open element is in
        self.open_: Counter = Counter()
        self.inside: list[str | None] = []

    def text(self, raw: str) -> None:
        self.parts.append((unescape(raw), self.open_["a"] > 0))

    def _taken(self) -> tuple[str, int, int]:
        text = _SPACE.sub(" ", "".join(t for t, _ in self.parts)).strip(" ")
        sizes = [(len(_SPACE.sub("", t)), linked) for t, linked in self.parts]
        self.parts = []
        return text, sum(n for n, _ in sizes), sum(n for n, linked in sizes if linked)

    def flush(self) -> None:
        """Ends the open block. In a table's cell, it becomes a part of the cell."""
        text, chars, linked = self._taken()
        if not text:
            return
        inside = self.inside[-1] if self.inside else None
        if inside in ("td", "th") and self.rows:
            cells = self.rows[-1] or [("", 0, 0)]
            before = cells[-1]
            self.rows[-1] = [*cells[:-1], (f"{before[0]} {text}".strip(), before[1] + chars, before[2] + linked)]
            return
        kind = "heading" if inside in HEADINGS else {"li": "item", "title": "title", "caption": "caption"}.get(inside, "text")
        self.blocks.append({"kind": kind, "level": HEADINGS.get(inside, 0), "text": text, "cells": None, "chars": chars, "link_chars": linked, "depth": len(self.stack)})

    def end_row(self) -> None:
        if self.rows and self.rows[-1]:
            cells, self.rows[-1] = self.rows[-1], []
            if any(t for t, _, _ in cells):
                self.blocks.append({
                    "kind": "row", "level": 0, "text": " | ".join(t for t, _, _ in cells), "cells": [t for t, _, _ in cells],
                    "chars": sum(n for _, n, _ in cells), "link_chars": sum(n for _, _, n in cells), "depth": len(self.stack),
                })

    def pop(self, to: int) -> None:
        """Closes the elements from place ``to`` on."""
        while len(self.stack) > to:
            name = self.stack[-1]
            if name not in INLINE:
                self.flush()
            self.stack.pop()
            self.inside.pop()
            self.open_[name] -= 1
            if name == "tr":
                self.end_row()
            elif name == "table" and self.rows:
                self.end_row()
                self.rows.pop()

    def open(self, name: str) -> None:
        names, until = CLOSES.get(name, ((), ()))
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] in names:
                self.pop(k)
                break
            if self.stack[k] in until:
                break
        if name not in INLINE:
            self.flush()
        if name in VOID or len(self.stack) == MOST_DEPTH:
            return
        if name == "table":
            self.rows.append([])
        elif name == "tr":
            self.end_row()
        elif name in ("td", "th") and self.rows:
            self.rows[-1].append(("", 0, 0))
        self.stack.append(name)
        self.inside.append(name if name in HEADINGS or name in BLOCKS else self.inside[-1] if self.inside else None)
        self.open_[name] += 1

    def close(self, name: str) -> None:
        if not self.open_[name]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] == name:
                self.pop(k)
                return
            if self.stack[k] == "table" and name not in ("body", "html"):
                return


def blocks_of(html: str | None) -> list[dict]:
    """The blocks of a page with text, in order: ``kind, level, text, cells, chars, link_chars, depth``.

    Kinds are title, heading (with its level), item, row (with its cells),
    caption and text. White space is squeezed; ``chars`` and ``link_chars``
    count what is no white space, all of it and that in links.

    A closing tag closes the nearest open element of its name and all in it,
    but none outside of its table; without such an element it does nothing. A
    paragraph, heading, item, cell or row ends an open one of its kind. What is
    open at the end ends there; elements over MOST_DEPTH deep are not opened. A ``<`` that begins no tag is text; a comment,
    script or tag that is not closed goes on to the end. Null is an empty page.
    """
    page = _Page()
    for kind, what in tokens(html or ""):
        if kind == "text":
            page.text(what)
        elif kind == "open":
            page.open(what)
        else:
            page.close(what)
    page.pop(0)
    page.flush()
    return page.blocks


def page_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``pages`` without its ``html``, and with ``blocks``, an array of the page's blocks; in Arrow batches, without a shuffle."""
    others = [c for c in pages.columns if c not in (html, "blocks")]
    kind = pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("cells", pa.list_(pa.string())), ("chars", pa.int32()), ("link_chars", pa.int32()), ("depth", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size = 0, 0
            # a few MB of pages at a time
            for k, page in enumerate(batch.column(0)):
                size += len(page.as_py() or "")
                if size > 4 << 20 or k + 1 == batch.num_rows:
                    part = batch.slice(at, k + 1 - at)
                    found = pa.array([blocks_of(p.as_py()) for p in part.column(0)], pa.list_(kind))
                    yield pa.RecordBatch.from_arrays([*part.columns[1:], found], names=[*others, "blocks"])
                    at, size = k + 1, 0

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*others).schema.fields), f"blocks array<{BLOCK}>"])
    return pages.select(html, *others).mapInArrow(read, schema)


def link_density(block: Column) -> Column:
    """The share of a block's characters that are in links."""
    return block["link_chars"] / F.greatest(block["chars"], F.lit(1))


def markup_documents(blocks: DataFrame, key: str = "page_id", source: Column | None = None, most_links: float = 0.5) -> DataFrame:
    """``doc_id, source, text`` of :func:`page_blocks`: a line for each block, headings marked by their level, rows with bars between cells.

    Blocks of which more than ``most_links`` is in links (menus, lists of
    links) and the title, which a page repeats, are left out. What finds
    sections and chunks in texts reads these.
    """
    kept = F.filter("blocks", lambda b: (link_density(b) <= most_links) & (b["kind"] != "title"))
    line = F.transform(kept, lambda b: F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["text"])).otherwise(b["text"]))
    return blocks.select(F.col(key).alias("doc_id"), (F.lit("pages") if source is None else source).alias("source"), F.array_join(line, "\n").alias("text"))


def host(url: Column) -> Column:
    """The host of an address, in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(T.strip(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))

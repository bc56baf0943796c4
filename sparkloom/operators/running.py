"""Running headers and footers: lines that a source's pages begin or end with again and again.

They are found, not given. The reading tasks keep a heavy-hitter sketch for
each source and edge (Misra and Gries, 1982; merged as in Agarwal et al., 2012),
which has few lines and misses none that is frequent enough; these candidates
are then counted exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions.frames import once
from sparkloom.sources.staging import staged
from sparkloom.sources.tables import LINES_PER_PAGE

#: The least share of a source's pages, and the least number of pages, that a running line is on.
SHARE, LEAST = 0.02, 3
#: Counters that a task holds before it sends its sketches on.
HELD = 1 << 17
EDGES = ("head", "foot")


def page_edges(documents: DataFrame) -> DataFrame:
    """``source, edge, line`` for ``documents(source, text)``: the first and the last line of each page, numbers as ``#``; a page without text has none."""
    rows = once(documents.select("source", "text").where("text is not null"), lines=F.transform(F.split("text", "\n"), T.strip))
    starts = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / LINES_PER_PAGE).cast("int"))
    pages = F.transform(starts, lambda k: F.filter(F.slice("lines", k * LINES_PER_PAGE + 1, LINES_PER_PAGE), lambda x: x != ""))
    edge = lambda name, line: F.struct(F.lit(name).alias("edge"), line.alias("line"))
    found = F.flatten(F.transform(F.filter(pages, lambda p: F.size(p) > 0), lambda p: F.array(edge(EDGES[0], p[0]), edge(EDGES[1], F.element_at(p, -1)))))
    cut = rows.select("source", F.explode(found).alias("e"))
    return cut.select("source", "e.edge", F.regexp_replace("e.line", "[0-9]+", "#").alias("line"))


def merged(counts: Counter, more: Counter, k: int) -> Counter:
    """The sketch of both, of ``k`` counters at most: each is short of the truth by at most a (k+1)-th of what was counted."""
    both = counts + more
    if len(both) <= k:
        return both
    cut = sorted(both.values(), reverse=True)[k]
    return Counter({x: n - cut for x, n in both.items() if n > cut})


def sketches(edges: DataFrame, k: int) -> DataFrame:
    """``source, edge, line, low, rows``: from each task, what its sketch counts of a line, and, with a null line, how many lines it has read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = {}
        rows: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            found = [(*key, line, n, 0) for key, counts in held.items() for line, n in counts.items()] + [(*key, None, 0, n) for key, n in rows.items()]
            columns = zip(*found, strict=True) if found else [()] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["source", "edge", "line", "low", "rows"])
            held.clear(), rows.clear()

        for batch in batches:
            now: dict[tuple, Counter] = {}
            for source, edge, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now.setdefault((source, edge), Counter())[line] += 1
            for key, counts in now.items():
                rows[key] += counts.total()
                held[key] = merged(held.get(key, Counter()), counts, k)
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    return edges.select("source", "edge", "line").mapInArrow(read, "source string, edge string, line string, low long, rows long")


def running_lines(documents: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``source, edge, line, n, pages`` for ``documents(source, text)``: lines on at least ``share`` of the source's pages, and ``least`` of them.

    ``edge`` is head or foot, ``n`` the pages that begin or end so, ``pages``
    those with text. A null source is one of its own. An empty table gives none.
    """
    edges = page_edges(documents)
    k = math.ceil(2 / share) - 1
    seen = staged(sketches(edges, k).groupBy("source", "edge", "line").agg(F.sum("low").alias("low"), F.sum("rows").alias("rows")), "sketches")
    totals = seen.where("line is null").select("source", "edge", F.col("rows").alias("pages"))
    same = lambda a, b, *names: [a[c].eqNullSafe(b[c]) for c in names]
    bound = F.greatest(F.lit(float(least)), F.lit(share) * F.col("pages"))
    named = seen.where("line is not null")
    # at most 2 / share lines of a source's edge can be frequent enough
    found = named.join(totals, same(named, totals, "source", "edge")).where(F.col("low") + F.col("pages") / (k + 1) >= bound)
    found = staged(found.select(named["source"].alias("of"), named["edge"].alias("at"), named["line"].alias("text"), "pages"), "running-candidates")
    counted = edges.join(found, edges["source"].eqNullSafe(found["of"]) & (edges["edge"] == found["at"]) & (edges["line"] == found["text"]))
    counted = counted.groupBy("source", "edge", "line").agg(F.count("*").alias("n"), F.first("pages").alias("pages"))
    return counted.where(F.col("n") >= bound)


def without_running_lines(documents: DataFrame, running: DataFrame) -> DataFrame:
    """``documents`` whose ``text`` lacks the lines that ``running`` names, where a page begins or ends with them; pages stay where they were, as lines become empty."""
    own = running.groupBy(F.col("source").alias("of_source")).agg(*[F.collect_set(F.when(F.col("edge") == e, F.col("line"))).alias(f"{e}_lines") for e in EDGES])
    # a row for each source, of 4 / share lines at most
    rows = documents.join(own, documents["source"].eqNullSafe(own["of_source"]), "left")
    rows = once(rows, lines_=F.split("text", "\n"))
    starts = F.sequence(F.lit(0), F.floor((F.size("lines_") - 1) / LINES_PER_PAGE).cast("int"))

    def page(k):
        part = F.slice("lines_", k * LINES_PER_PAGE + 1, LINES_PER_PAGE)
        full = F.filter(F.transform(part, lambda x, i: F.when(T.strip(x) != "", i)), lambda i: i.isNotNull())
        is_one = lambda x, names: F.coalesce(F.array_contains(names, F.regexp_replace(T.strip(x), "[0-9]+", "#")), F.lit(False))
        return F.transform(part, lambda x, i: F.when(
            ((i == F.array_min(full)) & is_one(x, F.col("head_lines"))) | ((i == F.array_max(full)) & is_one(x, F.col("foot_lines"))), "").otherwise(x))

    left = F.array_join(F.flatten(F.transform(starts, page)), "\n")
    touched = F.col("of_source").isNotNull() | F.col("head_lines").isNotNull()
    return rows.withColumn("text", F.when(touched & F.col("text").isNotNull(), left).otherwise(F.col("text"))).select(*documents.columns)

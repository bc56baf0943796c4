"""Headings: is a line one, of which level, and with which title."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions import text as T

# Fixed values.
NUMBERED = (
    r"^Cap[ií]tulo\s+[\dIVX]+[\s:.-]*(.+)$",
    r"^Chapter\s+[\dIVX]+[\s:.-]*(.+)$",
    r"^(?:\d+|[IVX]+)\s*[.:-]\s+(.+)$",
    r"^[\d.]+\s+(.+)$",
    r"^\d+\s*[-–—]\s*(.+)$",
)
FUNCTION_WORDS = ("el", "la", "los", "las", "un", "una", "es", "son", "está", "este")
SHORT_LINE, SHORT_WORDS, UPPER_LINE = 80, 10, (4, 99)

ANY_NUMBERED = "|".join(f"(?:{p})" for p in NUMBERED).replace("(.+)", ".+")


def is_heading(line: Column) -> Column:
    """Up to 8 words in title or upper case, or a line that starts with ``#``; ``line`` is stripped."""
    return (line != "") & (F.startswith(line, F.lit("#")) | T.is_title(line) | T.is_upper(line)) & (T.word_count(line) <= 8)


def level(line: Column) -> Column:
    """1 to 3, or 0 for a line that is no heading; ``line`` is stripped."""
    dots = F.length(F.regexp_extract(line, r"^\S+", 0)) - F.length(F.replace(F.regexp_extract(line, r"^\S+", 0), F.lit("."), F.lit("")))
    numbered = F.when(T.has_any(line, ("Capítulo", "Chapter")) | line.rlike("^[IVX]"), 1).when(line.rlike(r"^\d+\s*[.:-]"), F.least(2 + dots, F.lit(3))).otherwise(2)
    words = T.words(line)
    plain = (
        (F.length(line) < SHORT_LINE) & ~line.rlike("[.,;:]$") & F.size(words).between(2, SHORT_WORDS) & line.rlike(r"^\p{Lu}")
        & ~F.arrays_overlap(F.transform(F.slice(words, 1, 3), F.lower), F.array(*map(F.lit, FUNCTION_WORDS)))
    )
    return (
        F.when(line == "", 0).when(line.rlike(f"(?iu){ANY_NUMBERED}"), numbered)
        .when(F.startswith(line, F.lit("#")), F.least(F.length(F.regexp_extract(line, "^#+", 0)), F.lit(3)))
        .when((T.is_upper(line) & F.length(line).between(*UPPER_LINE)) | plain, 2).otherwise(0)
    )


def title(line: Column) -> Column:
    """What a heading line says: no number, no ``#``; a line in capitals gets title case."""
    said = None
    for p in NUMBERED:
        hit = line.rlike(f"(?iu){p}"), T.strip(F.regexp_extract(line, f"(?iu){p}", 1))
        said = F.when(*hit) if said is None else said.when(*hit)
    return said.when(F.startswith(line, F.lit("#")), T.strip(F.regexp_replace(line, "^#+", ""))).when(
        T.is_upper(line) & F.length(line).between(*UPPER_LINE), T.title_case(line)).otherwise(line)

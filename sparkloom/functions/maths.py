"""Formulas in texts: which lines hold one, how many there are, and texts with them marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.functions.frames import once

# Fixed values.
SYMBOLS = "∑∏∫∮√∛∜±∓≤≥≠≈≡≜≝∞πτσμλΔΣΠΩ∂∇∈∉⊂⊆⊇⊄∪∩→←↔⇒⇐⇔∀∃∅"
OPERATORS = "=+-*/^"
LONGEST = 160
LATEX = (r"\$\$[\s\S]+?\$\$", r"\\\[[\s\S]+?\\\]", r"\\\([\s\S]+?\\\)", r"\$[^$\n]+?\$")
EQUATION = r"^(?:[A-Za-z]+\s*\(\s*[A-Za-z0-9,\s]+\s*\)\s*=|[A-Za-z][A-Za-z0-9_]*\s*=.*[+\-*/^]|.{0,20}\\?\\?[A-Za-z]+\{.*\}.*|.*\^\s*[-0-9])"

#: Characters by which lines end and spans are found, what stands for them within a span, and what goes before a span.
SEEN, HELD, TOUCHED = "\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029$\\", "".join(chr(0xE000 + k) for k in range(12)), chr(0xE010)


def is_formula(line: Column) -> Column:
    """Two symbols; or, in a line of under 160 characters, a symbol and an operator, or an equation."""
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    operator = F.length(F.translate(line, OPERATORS, "")) < F.length(line)
    return (symbols >= 2) | ((F.length(line) < LONGEST) & (((symbols >= 1) & operator) | line.rlike(EQUATION)))


def _held(text: Column, pattern: str) -> Column:
    """``text`` with each match of the pattern marked, and what would be seen in it replaced."""
    spans = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s: F.concat(F.lit(TOUCHED), F.translate(s, SEEN, HELD)))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), spans, lambda part, s: F.concat(F.coalesce(part, F.lit("")), F.coalesce(s, F.lit("")))), "")


def with_lines(df: DataFrame, text: str, name: str = "lines") -> DataFrame:
    """``df`` with ``array<struct<line, touched, formula>>``: a text's lines; a LaTeX span is never cut, and no line that one touches is marked.

    Spans are found kind by kind, in the order of LATEX; what lies in one is not
    seen by the kinds after it, which may enclose it whole and count it then too.
    """
    out = df.withColumn(name, F.col(text))
    for pattern in LATEX:
        # texts without the pattern's first character are not searched
        out = once(out, **{name: F.when(F.contains(name, F.lit(pattern[1])), _held(F.col(name), pattern)).otherwise(F.col(name))})
    # the stripped line first: a lambda's repeated terms are worked out each time
    rows = F.transform(F.split(name, T.LINE_END), lambda x: F.struct(x.alias("line"), T.strip(x).alias("bare"), F.contains(x, F.lit(TOUCHED)).alias("touched")))
    lines = F.transform(rows, lambda r: F.struct(r["line"].alias("line"), r["touched"].alias("touched"), (~r["touched"] & is_formula(r["bare"])).alias("formula")))
    return once(out, **{name: lines})


def mark(lines: Column) -> Column:
    """The text of :func:`with_lines`, formulas between ``$$``; a line end at the very end is lost."""
    shown = F.transform(lines, lambda x: F.when(x["formula"], F.concat(F.lit("$$ "), T.strip(x["line"]), F.lit(" $$"))).when(
        x["touched"], F.translate(F.replace(x["line"], F.lit(TOUCHED), F.lit("")), HELD, SEEN)).otherwise(x["line"]))
    return F.regexp_replace(F.array_join(shown, "\n"), r"\n\z", "")


def formulas(lines: Column) -> Column:
    """LaTeX spans and marked lines of :func:`with_lines`."""
    spans = F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x["line"]) - F.length(F.replace(x["line"], F.lit(TOUCHED), F.lit(""))))
    return (spans + F.size(F.filter(lines, lambda x: x["formula"]))).cast("long")

"""What the SQL of several queries shares (DuckDB's dialect)."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({0}, '[^ \t\r\n]+')"
_SQUEEZE = f"array_to_string({_WORDS}, ' ')"


def w(x: str) -> str:
    return _WORDS.format(x)


def sq(x: str) -> str:
    return _SQUEEZE.format(x)


def any_of(x: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


CASED = r"\p{Lu}\p{Ll}\p{Lt}"
TITLE = rf"(regexp_matches(h, '[{CASED}]') AND NOT regexp_matches(h, '(^|[^{CASED}])\p{{Ll}}') AND NOT regexp_matches(h, '[{CASED}]\p{{Lu}}'))"
UPPER = r"(regexp_matches(h, '\p{Lu}') AND NOT regexp_matches(h, '[\p{Ll}\p{Lt}]'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[ \t\r\n\v\f]+|[ \t\r\n\v\f]+$', '', 'g')"

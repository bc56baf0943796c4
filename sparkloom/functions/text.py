"""Text columns: normalisation, words, predicates, question types."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
REFUSAL = "La informacion necesaria para responder esta pregunta no se encuentra en el documento provisto."
SYSTEM_PROMPT = f"Sos un asistente experto. Responde solo usando la informacion del documento provisto. Si la respuesta no esta en el documento, deci: '{REFUSAL}'"
KINDS = ("extractive", "inferential", "unanswerable", "multi_chunk", "format_specific")
MIX = {"extractive": 0.35, "inferential": 0.25, "unanswerable": 0.20, "multi_chunk": 0.15, "format_specific": 0.05}
TYPE_ALIASES = {
    "fact": "extractive", "factoid": "extractive", "factual": "extractive", "literal": "extractive", "extractive": "extractive", "extractive_qa": "extractive",
    "inferential": "inferential", "inference": "inferential",
    "unanswerable": "unanswerable", "trap": "unanswerable",
    "multi_chunk": "multi_chunk", "multihop": "multi_chunk", "multi_hop": "multi_chunk",
    "format_specific": "format_specific", "formatted": "format_specific",
}
FORMULA_MARKERS = ("=", "≈", "≤", "≥", "±", "√", "∑", "∫", "^", "->", "→")
COMPARISONS = ("diferencia", "compar", "mayor", "menor", "respecto", "supera", "debajo")
GAPS = ("no informa", "no menciona", "falta", "no detalla")
LISTS = ("1.", "2.", "3.")
LANGUAGES = {
    "es": "Spanish", "en": "English", "pt": "Portuguese", "fr": "French", "de": "German", "it": "Italian", "ca": "Catalan", "nl": "Dutch", "pl": "Polish",
    "ru": "Russian", "ja": "Japanese", "ko": "Korean", "zh-cn": "Simplified Chinese", "zh-tw": "Traditional Chinese", "ar": "Arabic", "hi": "Hindi", "tr": "Turkish",
}

FUNCTION_WORDS = {
    "en": ("the", "and", "of", "to", "is", "with", "that", "for"), "es": ("el", "los", "las", "y", "que", "una", "con", "por"),
    "de": ("der", "die", "und", "das", "nicht", "mit", "ist", "ein"), "fr": ("le", "les", "et", "des", "une", "est", "dans", "pour"),
}

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
SPACE = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def words(text: Column) -> Column:
    """Words between white space; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def squeeze(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.array_join(words(text), " ")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def token_count(text: Column, counter: Callable[[str], int] | None = None) -> Column:
    """Tokens by ``counter``, in Arrow batches; without one, words. None for a null or empty text."""
    if counter is None:
        return word_count(text)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: counter(t) if t else 0)

    return count(text)


def percent(share: Column) -> Column:
    """A share in whole per cent; 0% for none."""
    return F.when(share.isNull() | F.isnan(share), "0%").otherwise(F.concat(F.floor(share * 100 + 0.5).cast("long").cast("string"), F.lit("%")))


def eta(seconds: Column) -> Column:
    """Hours and minutes, minutes and seconds, or seconds; a dash for none left."""
    total = F.floor(seconds + 0.5).cast("long")
    h, m, s = (x.cast("string") for x in (F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60))
    said = F.when(total >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).when(total >= 60, F.concat(m, F.lit("m "), s, F.lit("s"))).otherwise(F.concat(s, F.lit("s")))
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds <= 0), "—").otherwise(said)


def relative(seconds: Column) -> Column:
    """How long ago, in the words of the dashboard."""
    sec = F.floor(seconds + 0.5)
    minutes, hours, days = F.floor(sec / 60 + 0.5), F.floor(F.floor(sec / 60 + 0.5) / 60 + 0.5), F.floor(F.floor(F.floor(sec / 60 + 0.5) / 60 + 0.5) / 24 + 0.5)
    ago = lambda n, unit: F.concat(F.lit("hace "), n.cast("long").cast("string"), F.lit(f" {unit}"))
    return F.when(sec < 60, "hace instantes").when(minutes < 60, ago(minutes, "min")).when(hours < 24, ago(hours, "h")).otherwise(ago(days, "d"))


def title_case(text: Column) -> Column:
    """Each run of cased letters with a capital first and lower case after it."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def token_set(text: Column) -> Column:
    """Distinct words of over 2 characters, in lower case."""
    return F.array_distinct(F.transform(F.filter(words(text), lambda w: F.length(w) > 2), F.lower))


def truncated(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis where text was cut."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most - 1), SPACE + "+$", ""), F.lit("…"))).otherwise(text)


def image_tokens(width: Column, height: Column) -> Column:
    """85, and 170 for each tile of 512 pixels; 0 without an area."""
    return F.when((width > 0) & (height > 0), 85 + 170 * F.ceil(width / 512) * F.ceil(height / 512)).otherwise(0).cast("long")


def language_name(code: Column) -> Column:
    """The English name; unknown codes stay, none is the source language."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(F.coalesce(code, F.lit("")))), F.when(code != "", code), F.lit("the source language"))


def language(text: Column, default: str = "es", least: int = 40, detector: Callable[[str], str] | None = None) -> Column:
    """The language by ``detector``, in Arrow batches, or else that with most of its function words among the first 4000 characters; a tie goes to the first named.

    Texts of under ``least`` characters, and those without such words, get ``default``.
    """
    head = F.substring(strip(text), 1, 4000)
    if detector is not None:

        @F.pandas_udf("string")
        def detect(texts: pd.Series) -> pd.Series:
            return texts.map(detector, na_action="ignore")

        return F.when(F.length(strip(text)) >= least, F.coalesce(detect(head), F.lit(default))).otherwise(default)
    found = F.transform(words(F.lower(head)), lambda w: F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", ""))

    def hits(k: int, name: str) -> Column:
        return F.struct(F.size(F.filter(found, lambda w: w.isin(*FUNCTION_WORDS[name]))).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name"))

    best = F.array_max(F.array(*[hits(k, name) for k, name in enumerate(FUNCTION_WORDS)]))
    return F.when((F.length(strip(text)) >= least) & (best["n"] > 0), best["name"]).otherwise(default)


def normalize_text(text: Column, repeated: Column | None = None) -> Column:
    """Join words hyphenated over a line end, drop empty and repeated lines, squeeze white space."""
    # most texts have no hyphen before a line end, and are not searched for words around one
    joined = F.when(text.rlike(r"(?U)-\s*\n"), F.regexp_replace(text, r"(?U)(\w+)-\s*\n\s*(\w+)", "$1$2")).otherwise(text)
    lines = F.transform(F.split(joined, LINE_END), strip)
    lines = F.filter(lines, lambda x: x != "")
    if repeated is not None:
        lines = F.filter(lines, lambda x: ~F.array_contains(repeated, x))
    return squeeze(F.array_join(lines, " "))


def is_upper(text: Column) -> Column:
    """Has cased letters, and none in lower or title case."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"[\p{Ll}\p{Lt}]")


def is_title(text: Column) -> Column:
    """Each run of cased letters starts with a capital and goes on in lower case."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    return text.rlike(f"[{cased}]") & ~text.rlike(f"(^|[^{cased}])\\p{{Ll}}") & ~text.rlike(f"[{cased}]\\p{{Lu}}")


def question_type(raw: Column) -> Column:
    """The kind that a type stands for; unknown types stay as they are, in lower case."""
    plain = F.regexp_replace(F.lower(strip(raw)), "[- ]", "_")
    aliases = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, plain), plain)


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found

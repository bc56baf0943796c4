"""Information-theoretic sanitisation with DataFrame functions only.

Patterns find the protected entities (mail and IP addresses, card and phone
numbers). Corpus co-occurrence then estimates how strongly a word in a text with
an entity reveals it: with N distinct texts, n_c holding the entity, n_t the word
outside of entities and n_ct both, the word's pointwise mutual information with the
entity, log(n_ct N / (n_c n_t)), is compared with the entity's information
content, log(N / n_c) (Sanchez and Batet, 2016). A share of 1 means that the
word gives the entity away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import marked, temporary, written

KINDS = ("email", "ip", "card", "phone")
#: The kinds' patterns. Those of mail addresses, IP addresses and cards start
#: only where a run of their characters starts, or where the last match ended,
#: and take runs whole: the same leftmost matches, without a retry from each
#: character of a long run. A card is a whole run of 13 to 19 digits, since a
#: run is always taken whole and other lengths are dropped.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "card": None}
MIN_SUPPORT, THRESHOLD = 3, 0.8

SPAN = "array<struct<start:int,end:int,value:string>>"
CUT, MARKED = "array<struct<from:int,to:int,mark:string>>", "array<struct<from:int,to:int,mark:string,end:int>>"
#: Spans of a text that are gone through at once.
STEP = 256


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits' checksum, doubling every second from the right, is 0 modulo 10."""
    at = F.split(F.reverse(_digits(value)), "")
    doubled = F.transform(at, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*[F.lit(2 * x - 9 * (x > 4)) for x in range(10)]), d.cast("int"))))
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        # a part of over three digits may have leading zeros
        whole = F.transform(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+(?=.)", ""))
        return F.forall(whole, lambda part: (F.length(part) <= 3) & (F.right(part, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def _folded(items: Column, kind: str, step) -> Column:
    """What ``step`` adds to ``out`` over the items, in order; its state is ``at`` (an int, 0 at first) and ``out`` (of type ``kind``).

    Adding to an array copies it, so the items go by chunks of STEP, whose
    arrays are put together at the end: time grows hardly faster than their number.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / STEP).cast("int")), lambda k: F.slice(items, k * STEP + 1, F.lit(STEP)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def whole(acc: Column, chunk: Column) -> Column:
        part = F.aggregate(chunk, F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out")), step)
        return _let(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], F.array(p["out"])).alias("out")))

    return F.flatten(F.aggregate(chunks, begin, whole)["out"])


def _pieces(text: Column, cuts: Column) -> Column:
    """The text's pieces ``from`` to ``to`` of ``cuts``, in order, each followed by its ``mark``, as one string.

    A piece is looked for in the part of the text that its chunk of STEP pieces lies in, not from the text's start.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / STEP).cast("int")), lambda k: F.slice(cuts, k * STEP + 1, F.lit(STEP)))

    def joined(c: Column) -> Column:
        begin = c[0]["from"]
        part = F.substring(text, begin + 1, F.element_at(c, -1)["to"] - begin)
        return _let(part, lambda block: F.array_join(F.transform(c, lambda x: F.concat(F.substring(block, x["from"] - begin + 1, x["to"] - x["from"]), x["mark"])), ""))

    return F.array_join(F.transform(chunks, joined), "")


def positions(text: Column, pattern: Column) -> Column:
    """All leftmost matches of a pattern as ``(start, end, value)``, in code points.

    The parts between the matches give the positions: ``split`` and
    ``regexp_extract_all`` find the same matches.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.zip_with(found, F.split(text, pattern, -1), lambda value, gap: F.struct(value.alias("value"), gap.alias("gap")))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return _let(F.filter(pairs, lambda p: p["value"].isNotNull()), lambda p: _folded(p, SPAN, step))


def _kept(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _labelled(spans: str, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _marked(spans: str, mark: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mark).alias("mark")))


def _named(spans: str, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with a column of spans for each kind; a null text is empty."""
    out = docs.withColumn("text", F.coalesce("text", F.lit("")))
    found = {}
    for kind in KINDS:
        pattern, needs = PATTERNS[kind], NEEDS[kind]
        there = F.col("text").rlike(pattern)
        if needs:
            there = F.contains("text", F.lit(needs)) & there
        spans = F.when(there, positions(F.col("text"), F.lit(pattern))).otherwise(F.array().cast(SPAN))
        found[kind] = _kept(spans, kind)
    return out.withColumns(found)


def _entities() -> Column:
    """All base spans of a row with their kinds."""
    return F.flatten(F.array(*[_labelled(kind, kind) for kind in KINDS]))


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))


def _outside() -> Column:
    """The text of a row with a space for each of its base spans."""
    spans = F.array_sort(F.flatten(F.array(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS])))

    def step(acc: Column, s: Column) -> Column:
        cut = F.struct(acc["at"].alias("from"), F.greatest(s["start"], acc["at"]).alias("to"), F.lit(" ").alias("mark"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(cut)).alias("out"))

    last = F.greatest(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    rest = F.struct(F.coalesce(last, F.lit(0)).alias("from"), F.length("text").alias("to"), F.lit("").alias("mark"))
    return _let(F.concat(_folded(spans, CUT, step), F.array(rest).cast(CUT)), lambda cuts: _pieces(F.col("text"), cuts))


def _single(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """``digest, text`` of each distinct text; only those whose digest may be among ``repeated`` are shuffled."""
    asked = marked(texts, "digest", repeated)
    return asked.where("not may").select("digest", "text").union(asked.where("may").groupBy("digest").agg(F.first("text").alias("text")))


def disclosing_terms(docs: DataFrame, held: DataFrame, min_support: int, threshold: float) -> DataFrame:
    """``kind, value, term, share``: words that reveal an entity by at least ``threshold``.

    ``held`` has the rows of ``docs`` with base spans. All counts are of
    distinct texts, and of the distinct words of each whole text outside of its
    base spans. A word must be with the entity in ``min_support`` texts, so
    entities in fewer are left out before their words are counted. Counts
    combine before a shuffle; no join has words of texts on both sides.
    """
    digests = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    times = written(digests.groupBy("digest").agg(F.count("*").alias("times")), "digests")
    n, repeated = times.count(), times.where("times > 1").select("digest")
    held = held.withColumn("digest", F.xxhash64("text"))
    seen = written(held.select("digest", F.explode(_entities()).alias("e")).select("digest", "e.kind", "e.value").distinct(), "seen")
    n_c = seen.groupBy("kind", "value").agg(F.count("*").alias("n_c")).where(F.col("n_c") >= min_support)
    n_c = written(n_c, "entities")
    about = seen.join(n_c, ["kind", "value"]).groupBy("digest").agg(F.collect_list(F.struct("kind", "value")).alias("about"))
    about = written(about, "about")
    asked = marked(held, "digest", about.select("digest")).where("may")
    texts = asked.select("digest", _outside().alias("outside")).groupBy("digest").agg(F.first("outside").alias("outside")).join(about, "digest")
    pairs = texts.select("about", F.explode(_words(F.col("outside"))).alias("term")).select(F.explode("about").alias("e"), "term")
    pairs = pairs.groupBy("e.kind", "e.value", "term").agg(F.count("*").alias("n_ct")).where(F.col("n_ct") >= min_support)
    pairs = written(pairs, "pairs")
    whole = _single(digests, repeated).select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    # words that a text has in its base spans only
    inside = held.select("digest", F.explode(F.array_except(_words(F.col("text")), _words(_outside()))).alias("term")).distinct()
    inside = inside.groupBy("term").agg(F.count("*").alias("n_inside"))
    terms = pairs.select("term").distinct()
    n_t = terms.join(whole, "term").join(inside, "term", "left").select("term", (F.col("n") - F.coalesce("n_inside", F.lit(0))).alias("n_t"))
    share = F.log(F.col("n_ct") * F.lit(float(n)) / (F.col("n_c") * F.col("n_t"))) / F.log(F.lit(float(n)) / F.col("n_c"))
    scored = pairs.join(n_c, ["kind", "value"]).join(n_t, "term").withColumn("share", F.when(F.col("n_c") < n, share).otherwise(F.lit(0.0)))
    return scored.where(F.col("share") >= threshold).select("kind", "value", "term", "share")


def sanitise(docs: DataFrame, min_support: int = MIN_SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the spans of each kind, ``terms``, and ``sanitised`` text of each row.

    ``sanitised`` is null where nothing changes: take the text itself then.
    ``terms`` are spans of words that reveal an entity of the same document by
    at least ``threshold``. In ``sanitised``, base spans become ``[KIND]``,
    words that give an entity away (share 1) are removed and other terms become
    ``[TERM]``; of overlapping spans the first counts. Null texts are empty,
    repeated rows give a row each, rows with a null doc_id get no terms; extra
    columns are not read. An empty table stays empty; a very long text is read
    whole, in time that grows hardly faster than its spans.
    """
    whole = docs.select("doc_id", "text")
    any_base = F.size(F.flatten(F.array(*[F.col(k) for k in KINDS]))) > 0
    spans = base_spans(whole).withColumn("has", any_base)
    base = written(spans.withColumn("text", F.when(F.col("has"), F.col("text"))), "base")
    held = base.where("has")
    with temporary() as keep:
        terms = keep(written(disclosing_terms(whole, held, min_support, threshold), "terms"))
    by_doc = (
        held.where("doc_id is not null").select("doc_id", F.explode(_entities()).alias("e")).select("doc_id", "e.kind", "e.value").distinct()
        .join(terms, ["kind", "value"]).groupBy("doc_id", "term").agg(F.max("share").alias("share"))
        .groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
    )
    no_terms = F.array().cast("array<struct<start:int,end:int,value:string,share:double>>")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.array_sort(F.map_keys("shares")), "|"), F.lit(r")(?!\p{L})"))
    with_terms = held.join(by_doc, "doc_id", "left").withColumn("pattern", pattern)
    found = positions(F.col("text"), F.col("pattern"))
    base_list = F.flatten(F.array(*[F.col(k) for k in KINDS]))
    free = F.filter(found, lambda t: ~F.exists(base_list, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    valued = F.transform(free, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"), F.coalesce(F.try_element_at("shares", F.lower(t["value"])), F.lit(0.0)).alias("share")))
    with_terms = with_terms.withColumn("terms", F.when(F.col("shares").isNotNull(), valued).otherwise(no_terms))
    columns = ["doc_id", *KINDS, "terms"]
    out = with_terms.select(*columns, _replaced().alias("sanitised"))
    return out.union(base.where("not has").select("doc_id", *KINDS, no_terms.alias("terms"), F.lit(None).cast("string").alias("sanitised")))


def _replaced() -> Column:
    """The text with its spans replaced, from the columns of a row."""
    marks = [_marked(k, f"[{k.upper()}]") for k in KINDS]
    marks.append(F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["share"] < 1, "[TERM]").otherwise("").alias("mark"))))
    spans = F.array_sort(F.flatten(F.array(*marks)))

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["at"]
        cut = F.struct(acc["at"].alias("from"), s["start"].alias("to"), s["mark"].alias("mark"), s["end"].alias("end"))
        return F.struct(F.when(free, s["end"]).otherwise(acc["at"]).alias("at"), F.when(free, F.concat(acc["out"], F.array(cut))).otherwise(acc["out"]).alias("out"))

    def text(cuts: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(cuts, lambda c: c["end"])), F.lit(0))
        rest = F.array(F.struct(last.alias("from"), F.length("text").alias("to"), F.lit("").alias("mark"))).cast(CUT)
        plain = F.transform(cuts, lambda c: F.struct(c["from"].alias("from"), c["to"].alias("to"), c["mark"].alias("mark"))).cast(CUT)
        return _let(F.concat(plain, rest), lambda all_: _pieces(F.col("text"), all_))

    return _let(_folded(spans, MARKED, step), text)


def joined_spans(columns: dict[str, str]) -> Column:
    """``kind:start:end`` of the spans in these columns, comma-joined, in this order."""
    lists = [_named(c, kind) for kind, c in columns.items()]
    return F.array_join(F.flatten(F.array(*lists)), ",")

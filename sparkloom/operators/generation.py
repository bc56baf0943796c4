"""From planned targets to examples and scores: contexts, prompts, a teacher's and a judge's answers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import text as T
from sparkloom.functions.frames import once

# Fixed values.
TEACHER = "You are an expert dataset curator for fine-tuning large language models. Generate exactly one training example per request, strictly grounded in the provided document fragments. Output must be valid JSON matching the provided schema. Never invent facts outside the document."
RULES = {
    "extractive": "Produce a question whose answer is a literal verbatim span from the fragment. Keys required: question, answer, evidence, question_type, difficulty, is_answerable.",
    "inferential": "Produce a question that requires a single inference step over the facts present in the fragment. Keys required: question, answer, evidence, reasoning, supporting_facts, question_type, difficulty, is_answerable.",
    "unanswerable": "Produce a plausible question that CANNOT be answered from the fragment. is_answerable must be false and the answer must be the provided refusal text. Keys required: question, answer, evidence, question_type, difficulty, is_answerable.",
    "multi_chunk": "Produce a question that can only be answered by combining information across the fragments. The question must not be answerable from a single fragment alone. Keys required: question, answer, evidence, reasoning, supporting_facts, question_type, difficulty, is_answerable.",
    "format_specific": "Produce a question whose answer must follow an explicit format such as a numbered list, bullet list, table, or JSON. Keys required: question, answer, evidence, question_type, difficulty, is_answerable.",
}
UNANSWERABLE_NOTE = "\nIMPORTANT: For unanswerable questions, you have visibility of the entire chapter/section. The question must be PLAUSIBLE (related to the topic) but the answer must NOT be found in any of the provided context. Think about what a reader might ask but the text doesn't cover."
IMAGES_NOTE = "\nPage images may be attached alongside the text (formulas, tables, scanned content). Use them only as support for the same document."
JUDGE = ("You are a strict quality judge for synthetic training datasets. Score relevance, groundedness, format, difficulty and overall in the 0-1 range. Reply ONLY with valid JSON matching the required schema. The evaluated item is written in ", "; evaluate it accordingly.")
JUDGE_TASK = "Score whether the answer is grounded in the evidence, whether the format is adequate, and the overall quality."
SCORES = ("relevance", "groundedness", "format", "difficulty", "overall")
NO_SCORE = "judge response did not match schema"
HEADINGS, PREVIEW_WORDS, CONTEXT_CHARS = 5, 80, 8000


def _string(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def summaries(chunks: DataFrame, by: str = "batch") -> DataFrame:
    """``by, summary, context``: what the chunks of a group are about, and its first 8000 characters.

    Needs ``doc_id, chunk_ord, heading, page_start, page_end, text``. Only the
    first chunks of a group, as many as can matter, are gathered; the limit is
    applied before the shuffle.
    """
    order = Window.partitionBy(by).orderBy("doc_id", "chunk_ord")
    label = F.when(F.coalesce("heading", F.lit("")) != "", F.col("heading")).otherwise(F.concat(F.lit("Pages "), _string("page_start"), F.lit("-"), _string("page_end")))
    named = chunks.select(by, label.alias("label"), F.struct("doc_id", "chunk_ord").alias("at")).groupBy(by, "label").agg(F.min("at").alias("at")).select(by, "label", "at.*")
    named = named.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= HEADINGS).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("nth", "label"))).alias("labels"))
    part, words = F.substring("text", 1, CONTEXT_CHARS), F.array_join(F.slice(T.words(F.col("text")), 1, PREVIEW_WORDS), " ")
    first = chunks.select(by, "chunk_ord", "doc_id", part.alias("part"), words.alias("words")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= CONTEXT_CHARS // 3 + 1)
    first = first.withColumn("before", F.coalesce(F.sum(F.length("part") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = first.where((F.col("nth") <= PREVIEW_WORDS) | (F.col("before") < CONTEXT_CHARS))
    heads = once(kept.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("nth", "words", "part", "doc_id"))).alias("c")), context=F.array_join(F.transform("c", lambda x: x["part"]), "\n\n"))
    counts = chunks.groupBy(by).agg(F.count("*").alias("n"))
    preview = F.array_join(F.slice(T.words(F.array_join(F.transform(F.slice("c", 1, PREVIEW_WORDS), lambda x: x["words"]), " ")), 1, PREVIEW_WORDS), " ")
    text = F.concat(
        F.lit("Document: doc-"), _string(F.col("c")[0]["doc_id"]), F.lit("\nChunk count: "), _string("n"), F.lit("\nStructure: "), F.array_join(F.transform("labels", lambda x: x["label"]), "; "),
        F.when(F.length(preview) > 0, F.concat(F.lit("\nPreview: "), preview)).otherwise(""),
    )
    return heads.join(counts, by).join(named, by).select(by, text.alias("summary"), F.substring("context", 1, CONTEXT_CHARS).alias("context"))


def contexts(targets: DataFrame, chunks: DataFrame) -> DataFrame:
    """``targets(batch, kind, pick, chunk_id)`` with ``fragments`` and the kind to ask for, ``asked``.

    A multi_chunk target takes its chunk's first neighbour too; without one it
    asks for an inferential question, which can't match later. Needs
    ``chunk_id, doc_id, heading, page_start, page_end, text, neighbors``.
    """
    fragment = F.struct("chunk_id", "doc_id", F.coalesce("heading", F.lit("")).alias("heading"), "page_start", "page_end", "text")
    rows = targets.join(chunks.select("chunk_id", "doc_id", F.get("neighbors", F.lit(0)).alias("near"), fragment.alias("own")), "chunk_id")
    wants = (F.col("kind") == "multi_chunk") & F.col("near").isNotNull()
    alone = rows.where(~F.coalesce(wants, F.lit(False))).withColumn("fragments", F.array("own"))
    beside = chunks.select(F.col("chunk_id").alias("near"), fragment.alias("other"))
    paired = rows.where(wants).join(beside, "near", "left").withColumn("fragments", F.when(F.col("other").isNull(), F.array("own")).otherwise(F.array("own", "other"))).drop("other")
    both = alone.unionByName(paired).drop("own", "near")
    return both.withColumn("asked", F.when((F.col("kind") == "multi_chunk") & (F.size("fragments") < 2), "inferential").otherwise(F.col("kind")))


def prompts(context: DataFrame, about: DataFrame, language: str = "en", images: Column | None = None, by: str = "batch") -> DataFrame:
    """:func:`contexts` with ``system`` and ``user``; ``about`` are the :func:`summaries` of the batches."""
    name, asked = T.language_name(F.lit(language)), F.col("asked")
    rules = F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair])
    hard = asked == "unanswerable"
    system = F.concat(
        F.lit(f"{TEACHER}\nOutput language: "), name, F.lit(f" ({language}). Reply ONLY in "), name, F.lit(".\nRequired question type: '"), asked, F.lit("'. The field question_type must equal '"), asked, F.lit("'.\n"),
        F.try_element_at(rules, asked), F.when(F.lit(False) if images is None else images, IMAGES_NOTE).otherwise(""),
        F.when(hard, f"{UNANSWERABLE_NOTE}\nIf is_answerable is false the answer MUST be exactly: '{T.REFUSAL}'.").otherwise(""),
    )
    shown = F.transform("fragments", lambda f, i: F.concat(
        F.lit("FRAGMENT "), _string(i + 1), F.lit("\nSection: "), f["heading"], F.lit("\nDoc: doc-"), _string(f["doc_id"]), F.lit("\nPages: "), _string(f["page_start"]), F.lit("-"), _string(f["page_end"]), F.lit("\n"), f["text"]))
    overview = F.concat(F.lit("DOCUMENT OVERVIEW:\n"), F.col("summary"), F.when(hard, F.concat(F.lit("\n\nFULL DOCUMENT CONTEXT:\n"), F.col("context"))).otherwise(""), F.lit("\n\n" + "=" * 60))
    return context.join(about, by, "left").withColumn("system", system).withColumn("user", F.concat_ws("\n\n", overview, F.array_join(shown, "\n\n"))).drop("summary", "context")


class Backend(Protocol):
    """Answers one request; made on the driver, pickled to the tasks."""

    def answer(self, system: str, user: str, session: str) -> dict: ...


class EchoTeacher:
    """A teacher without a model: quotes the first fragment. Now and then its first answer is of no kind."""

    def answer(self, system: str, user: str, session: str) -> dict:
        kind = re.search(r"Required question type: '(\w+)'", system)[1]
        said = re.split(r"FRAGMENT 1\n(?:.*\n){3}", user, maxsplit=1)[-1]
        quote = " ".join(re.findall(r"[^ \t\r\n]+", said)[:12])
        if session.endswith("-attempt-1") and len(user) % 4 == 0:
            kind = "other"
        return {"question": f"What is said in {session.rpartition('-attempt-')[0]}?", "answer": quote, "evidence": [quote, "FRAGMENTO 1"], "question_type": kind, "is_answerable": kind != "unanswerable"}


def generate(prompted: DataFrame, backend: Backend, attempts: int = 3) -> DataFrame:
    """``batch, kind, pick, chunk_id, response`` (JSON) ``, attempts``: asks until the kind is right, at most ``attempts`` times; the last answer stays.

    One request at a time in each task; Spark's tasks are the pool.
    """
    keys = ["batch", "kind", "pick", "chunk_id"]

    def ask(frames: Iterator) -> Iterator:
        for frame in frames:
            said, used = [], []
            for kind, chunk, system, user, n in zip(frame["kind"], frame["chunk_id"], frame["system"], frame["user"], frame["n"], strict=True):
                for k in range(1, max(1, attempts) + 1):
                    reply = backend.answer(system, user, f"{chunk}-attempt-{k}")
                    raw = re.sub("[- ]", "_", str(reply.get("question_type", kind)).strip().lower())
                    if T.TYPE_ALIASES.get(raw, raw) == kind and (kind != "multi_chunk" or n > 1):
                        break
                said.append(json.dumps(reply, ensure_ascii=False))
                used.append(k)
            yield frame[keys].assign(response=said, attempts=used)

    narrow = prompted.select(*keys, "system", "user", F.size("fragments").alias("n"))
    return narrow.mapInPandas(ask, narrow.select(*keys).schema.add("response", "string").add("attempts", "long"))


def resolved_evidence(given: Column, texts: Column, answerable: Column) -> Column:
    """A refusal's evidence is what was given, less blanks; else what was given, less blanks and placeholders, and then the fragments' texts, each once."""
    full = F.filter(F.coalesce(given, F.array().cast("array<string>")), lambda e: T.strip(e) != "")
    real = F.filter(F.transform(full, T.strip), lambda e: ~F.lower(e).startswith("fragmento ") & ~F.lower(e).isin("fragmento", "evidence", "evidencia"))
    sources = F.filter(F.transform(texts, T.strip), lambda t: t != "")
    return F.when(answerable, F.array_distinct(F.concat(real, sources))).otherwise(full)


def image_parts(fragments: Column, most: int) -> Column:
    """Paths of page images to attach: those of the fragments' ``page_image_paths`` in order, each once, ``most`` (at least one) of them."""
    return F.slice(F.array_distinct(F.flatten(F.transform(fragments, lambda f: f["page_image_paths"]))), 1, max(1, most))


def existing_images(rows: DataFrame, key: str, images: DataFrame, column: str = "page_image_paths") -> DataFrame:
    """``rows`` whose array of paths keeps only those that ``images(path)`` lists, in their order; ``key`` is unique.

    What is listed comes from the store in one go (:func:`sparkloom.sources.files.listing`), not path by path.
    """
    named = rows.select(key, F.posexplode(column).alias("k", "path"))
    there = named.join(images.select("path").distinct(), "path", "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "path"))).alias("there_"))
    kept = F.coalesce(F.transform("there_", lambda x: x["path"]), F.array().cast("array<string>"))
    return rows.join(there, key, "left").withColumn(column, F.when(F.col(column).isNotNull(), kept)).drop("there_").select(*rows.columns)


def examples_of(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Examples of :func:`generate`'s answers: refusals, evidence, ids and whether the kind is the one asked for."""
    schema = "question string, answer string, evidence array<string>, question_type string, is_answerable boolean"
    rows = answers.join(context.select("batch", "kind", "pick", "chunk_id", "fragments", "asked"), ["batch", "kind", "pick", "chunk_id"])
    rows = once(rows, r=F.from_json("response", schema))
    refuses = F.col("asked") == "unanswerable"
    can = ~refuses & F.coalesce("r.is_answerable", F.lit(True))
    answer = T.strip(F.coalesce("r.answer", F.lit("")))
    rows = rows.withColumns({"is_answerable": can, "answer": F.when(refuses | (~can & (answer == "")), T.REFUSAL).otherwise(answer)})
    ids = F.transform("fragments", lambda f: f["chunk_id"])
    question = F.coalesce("r.question", F.lit(""))
    kind = T.question_type(F.coalesce("r.question_type", F.col("asked")))
    matches = (kind == F.col("kind")) & F.when(F.col("kind") == "unanswerable", ~F.col("is_answerable") & (F.col("answer") == T.REFUSAL)).when(F.col("kind") == "multi_chunk", F.size(ids) > 1).otherwise(True)
    return rows.select(
        "batch", "kind", "pick", "chunk_id", F.col("fragments")[0]["doc_id"].alias("doc_id"), ids.alias("chunk_ids"), F.col("fragments")[0]["page_start"].alias("page_start"), F.element_at("fragments", -1)["page_end"].alias("page_end"),
        F.substring(F.sha1(F.concat(F.array_join(ids, "|"), F.lit("|"), question)), 1, 12).alias("example_id"), kind.alias("question_type"), "is_answerable", T.strip(question).alias("question"), "answer",
        resolved_evidence(F.col("r.evidence"), F.transform("fragments", lambda f: f["text"]), F.col("is_answerable")).alias("evidence"), matches.alias("matches"), "attempts",
    )


def judge_prompts(examples: DataFrame, language: str = "en") -> DataFrame:
    """``examples`` with ``judge_system`` and ``judge_user``."""
    evidence = F.when(F.size("evidence") > 0, F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("- "), e)), "\n")).otherwise("- no evidence provided")
    user = F.concat(F.lit("QUESTION:\n"), F.col("question"), F.lit("\n\nANSWER:\n"), F.col("answer"), F.lit("\n\nEVIDENCE:\n"), evidence, F.lit(f"\n\n{JUDGE_TASK}"))
    return examples.withColumn("judge_system", F.concat(F.lit(JUDGE[0]), T.language_name(F.lit(language)), F.lit(f" ({language}){JUDGE[1]}"))).withColumn("judge_user", user)


def judge_scores(responses: DataFrame, raw: str = "response") -> DataFrame:
    """``responses`` with the five scores and ``rationale`` of a JSON text; all 0 if a field is missing or no number. Numbers may come as strings."""
    rows = once(responses, j=F.from_json(raw, ", ".join(f"{s} string" for s in (*SCORES, "rationale"))))
    numbers = [F.col(f"j.{s}").try_cast("double") for s in SCORES]
    fine = F.col("j.rationale").isNotNull()
    for x in numbers:
        fine = fine & x.isNotNull()
    out = {s: F.when(fine, x).otherwise(0.0) for s, x in zip(SCORES, numbers, strict=True)}
    return rows.withColumns(out | {"rationale": F.when(fine, F.col("j.rationale")).otherwise(NO_SCORE)}).drop("j")


class EchoJudge:
    """A judge without a model: scores an item by the share of the answer's words that its evidence holds."""

    def answer(self, system: str, user: str, session: str) -> dict:
        said = user.partition("\n\nANSWER:\n")[2].partition("\n\nEVIDENCE:\n")
        words, evidence = said[0].split(), said[2]
        share = round(sum(w in evidence for w in words) / len(words), 3) if words else 0.0
        return {"relevance": 0.8, "groundedness": share, "format": 1.0, "difficulty": 0.5, "overall": share, "rationale": "words in the evidence"}


def judged(examples: DataFrame, earlier: DataFrame, backend: Backend, language: str = "en") -> DataFrame:
    """``examples`` with their scores: the last written of ``earlier(example_id, seq, scores...)``, or the judge's for ids that have none.

    Rows with the same id share one score; only the ids without one are asked about, each once.
    """
    named = [*SCORES, "rationale"]
    last = earlier.groupBy("example_id").agg(F.max_by(F.struct(*named), "seq").alias("s")).select("example_id", "s.*")
    first = examples.join(last, "example_id", "left_anti").groupBy("example_id").agg(F.min_by(F.struct("question", "answer", "evidence"), "example_ord").alias("e")).select("example_id", "e.*")
    asked = judge_prompts(first, language).select("example_id", "judge_system", "judge_user")

    def ask(frames: Iterator) -> Iterator:
        for frame in frames:
            said = [json.dumps(backend.answer(s, u, i), ensure_ascii=False) for i, s, u in zip(frame["example_id"], frame["judge_system"], frame["judge_user"], strict=True)]
            yield frame[["example_id"]].assign(response=said)

    new = judge_scores(asked.mapInPandas(ask, "example_id string, response string")).select("example_id", *named)
    return examples.drop(*named).join(last.union(new), "example_id", "left")


def adopt_scores(generated: DataFrame, scored: DataFrame) -> DataFrame:
    """``generated`` with the last score written for its example_id, null where none is: those are still to be judged. ``scored(example_id, seq, overall, groundedness)``."""
    last = scored.groupBy("example_id").agg(F.max_by(F.struct("overall", "groundedness"), "seq").alias("s")).select("example_id", "s.*")
    return generated.drop("overall", "groundedness").join(last, "example_id", "left")

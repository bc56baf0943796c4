"""Judged examples: the rule cascade, its summary, exports and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T

PRESETS = {"strict": 0.85, "balanced": 0.70, "permissive": 0.55}


def example_id(df: DataFrame) -> DataFrame:
    """Adds ``example_id``; equal for a repeated question on the same chunks."""
    return df.withColumn("example_id", F.substring(F.sha1(F.concat(F.array_join("chunk_ids", "|"), F.lit("|"), F.col("question"))), 1, 12))


def curate(examples: DataFrame, preset: str = "balanced", groundedness: float | None = None, overall: float | None = None) -> DataFrame:
    """``examples`` with ``reason``: null if accepted, else the first rule that rejects.

    A row is a duplicate if an earlier row of its fingerprint was accepted; the
    earliest row that no other rule rejects is. One partial aggregate and a
    join on the fingerprint's digest; no window over the texts.
    """
    level = PRESETS.get(preset, PRESETS["balanced"])
    g, o = level if groundedness is None else groundedness, level if overall is None else overall
    print_ = F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), F.lower(T.strip(F.col("question"))), F.lower(T.strip(F.col("answer")))))
    own = (
        F.when(F.col("is_answerable") & (F.size("evidence") == 0), "missing_evidence")
        .when((F.col("requested_kind") != "") & (T.question_type(F.col("question_type")) != F.col("requested_kind")), "question_type_mismatch")
        .when(~F.col("is_answerable") & (T.strip(F.col("answer")) != T.REFUSAL), "invalid_refusal")
        .when(F.col("overall").isNull(), "missing_judge_score")
        .when(F.col("groundedness") < g, "low_groundedness")
        .when(F.col("overall") < o, "low_overall")
    )
    rows = examples.withColumn("own", own).withColumn("print", print_)
    first = rows.where("own is null").groupBy("print").agg(F.min("example_ord").alias("first_ok"))
    reason = F.when(F.col("example_ord") > F.col("first_ok"), "duplicate").otherwise(F.col("own"))
    return rows.join(first, "print", "left").withColumn("reason", reason).drop("print", "own", "first_ok")


def summary(curated: DataFrame, *by: str) -> DataFrame:
    """Rows per reason (``accepted`` for none); also after edits, as it counts what is there."""
    return curated.groupBy(*by, F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


def totals(curated: DataFrame, *by: str) -> DataFrame:
    """``total_input, accepted, rejected, rejected_by_reason`` of each group, the last as a map."""
    counts = curated.groupBy(*by, "reason").agg(F.count("*").alias("n"))
    accepted = F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0))
    why = F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))
    return counts.groupBy(*by).agg(F.sum("n").alias("total_input"), accepted.alias("accepted"), (F.sum("n") - accepted).alias("rejected"), F.map_from_entries(why).alias("rejected_by_reason"))


#: What a record says of its example, in this order; a column that is not there is null.
METADATA = {
    "example_id": "string", "source_doc": "string", "doc_id": "string", "chunk_ids": "array<string>", "page_range": "array<bigint>", "question_type": "string", "difficulty": "string",
    "is_answerable": "boolean", "teacher_model": "string", "judge_model": "string", "quality_score": "double", "split": "string", "prompt_version": "string", "language": "string",
}


def training_records(accepted: DataFrame, system_prompt: str = T.SYSTEM_PROMPT) -> DataFrame:
    """Chat records: ``example_ord, messages, metadata``; the judge's model is the teacher's, a missing score 0."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    there = {c: F.col(c) for c in accepted.columns}
    there |= {"question_type": T.question_type(F.col("question_type")), "quality_score": F.coalesce("overall", F.lit(0.0)), "judge_model": there.get("teacher_model", F.lit(None))}
    if "page_start" in accepted.columns:
        there["page_range"] = F.array("page_start", "page_end")
    metadata = F.struct(*[there.get(n, F.lit(None)).cast(t).alias(n) for n, t in METADATA.items()])
    messages = F.array(message("system", F.lit(system_prompt)), message("user", F.col("question")), message("assistant", F.col("answer")))
    return accepted.select("example_ord", messages.alias("messages"), metadata.alias("metadata"))


def review_sample(accepted: DataFrame, size: int = 100) -> DataFrame:
    """The first ``size`` by type, score and id, as a top-k."""
    return accepted.withColumn("score", F.coalesce("overall", F.lit(0.0))).orderBy("question_type", "score", "example_id", "example_ord").limit(max(1, size)).select(
        "example_ord", "example_id", T.question_type(F.col("question_type")).alias("question_type"), F.col("score").alias("quality_score"), "split"
    )


#: The scores of an example that a person accepts without a judge's.
MANUAL = {"relevance": 0.8, "groundedness": 0.8, "format": 0.8, "difficulty": 0.5, "overall": 0.8}


def find(curated: DataFrame, ids: DataFrame) -> DataFrame:
    """``example_id, bucket`` of these ids in each split: ``accepted`` if any row of the id is, else ``rejected``; null where there is none."""
    seen = curated.groupBy("example_id", "split").agg(F.when(F.max(F.col("reason").isNull()), "accepted").otherwise("rejected").alias("bucket"))
    return ids.select("example_id").distinct().join(seen, "example_id", "left")


def _chosen(curated: DataFrame, ids: DataFrame) -> DataFrame:
    """``curated`` with ``chosen`` and, for those, the ``bucket`` that their id is found in."""
    named = curated.join(ids.select("example_id", F.lit(True).alias("chosen")).distinct(), "example_id", "left")
    found = curated.join(ids.select("example_id"), "example_id", "left_semi").groupBy("example_id", "split").agg(F.max(F.col("reason").isNull()).alias("has_accepted"), F.max("example_ord").alias("last_ord"))
    return named.join(found, ["example_id", "split"], "left")


def accept(curated: DataFrame, ids: DataFrame) -> DataFrame:
    """The rejected rows of these ids are accepted, unless the id is accepted already; of several rows of an id the last, and the others go.

    Without a judge's score the row gets the manual one, with a rationale where there is such a column.
    """
    rows = _chosen(curated, ids)
    now = F.coalesce(F.col("chosen") & ~F.col("has_accepted"), F.lit(False))
    unscored = now & F.col("overall").isNull()
    # an example's own difficulty is a word, not a score
    numbers = {name for name, kind in curated.dtypes if kind in ("double", "float")}
    scores = {c: F.when(unscored, F.lit(v)).otherwise(F.col(c)) for c, v in MANUAL.items() if c in numbers}
    if "rationale" in curated.columns:
        scores["rationale"] = F.when(unscored, "manual override").otherwise(F.col("rationale"))
    kept = rows.where(~now | (F.col("example_ord") == F.col("last_ord")))
    return kept.withColumns(scores | {"reason": F.when(now, None).otherwise(F.col("reason"))}).select(*curated.columns)


def reject(curated: DataFrame, ids: DataFrame, reason: str = "manual_rejection") -> DataFrame:
    """The accepted rows of these ids are rejected; of several accepted rows of an id the last, and the others go. An id with rejected rows only stays as it is."""
    rows = _chosen(curated, ids)
    accepted = curated.where("reason is null").groupBy("example_id", "split").agg(F.max("example_ord").alias("last_accepted"))
    rows = rows.join(accepted, ["example_id", "split"], "left")
    now = F.coalesce(F.col("chosen"), F.lit(False)) & F.col("reason").isNull()
    kept = rows.where(~now | (F.col("example_ord") == F.col("last_accepted")))
    return kept.withColumn("reason", F.when(now, reason).otherwise(F.col("reason"))).select(*curated.columns)


def bulk_edit(curated: DataFrame, selection: DataFrame, action: str, reason: str = "manual_rejection") -> DataFrame:
    """``accept``, ``reject`` or ``delete`` all examples of a selection at once; those already in that state stay."""
    edits = {"accept": lambda: accept(curated, selection), "reject": lambda: reject(curated, selection, reason), "delete": lambda: delete(curated, selection)}
    if action not in edits:
        raise ValueError(f"unknown action: {action}")
    return edits[action]()


def edges_by_job(curated: DataFrame) -> DataFrame:
    """Accepted and rejected rows of each job and split."""
    return curated.groupBy("job_id", "split").agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))


PATCHABLE = ("question", "answer", "evidence", "question_type", "difficulty", "reasoning", "is_answerable")


def patch(curated: DataFrame, patches: DataFrame) -> DataFrame:
    """``curated`` with the fields that ``patches`` (one row an example_id; null: unchanged) gives; scores and verdicts stay."""
    given = [c for c in patches.columns if c in PATCHABLE and c in curated.columns]
    new = patches.select("example_id", *[F.col(c).alias(f"new_{c}") for c in given])
    joined = curated.join(new, "example_id", "left")
    return joined.withColumns({c: F.coalesce(f"new_{c}", c) for c in given}).select(*curated.columns)


def delete(curated: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the rows of these ids in the bucket they are found in: the accepted, if any of the id is in that split, else the rejected."""
    rows = _chosen(curated, ids)
    gone = F.coalesce(F.col("chosen") & (F.col("has_accepted") == F.col("reason").isNull()), F.lit(False))
    return rows.where(~gone).select(*curated.columns)

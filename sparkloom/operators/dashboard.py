"""Filters, pages, counts and histograms over curated examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T


TRUE, FALSE = ("1", "true", "yes"), ("0", "false", "no")


def tagged(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """Accepted and rejected examples as one table, with ``accepted`` and a ``reason``, which is null for the former."""
    return accepted.drop("reason").withColumns({"accepted": F.lit(True), "reason": F.lit(None).cast("string")}).unionByName(rejected.withColumn("accepted", F.lit(False)), allowMissingColumns=True)


def accepted_flag(value: str | None) -> bool | None:
    """What a request's filter says: yes, no, or (anything else) both."""
    plain = (value or "").strip().lower()
    return True if plain in TRUE else False if plain in FALSE else None


def filtered(rows: DataFrame, split: str | None = None, accepted: bool | None = None, kind: str | None = None, min_score: float | None = None, search: str | None = None) -> DataFrame:
    """Rows that meet all the filters given; a missing score counts as 0. The search looks into question, answer and source_doc."""
    if split:
        rows = rows.where(F.col("split") == split)
    if accepted is not None:
        rows = rows.where(F.col("reason").isNull() if accepted else F.col("reason").isNotNull())
    if kind:
        rows = rows.where(F.lower("question_type") == kind.lower())
    if min_score is not None:
        rows = rows.where(F.coalesce("overall", F.lit(0.0)) >= min_score)
    if search:
        needle, found = F.lit(search.lower()), F.lit(False)
        for c in ("question", "answer", "source_doc"):
            if c in rows.columns:
                found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), needle)
        rows = rows.where(found)
    return rows


#: The most rows of a page: of one job's examples, and of all jobs'.
JOB_PAGE, ALL_PAGE = 200, 500


def page(rows: DataFrame, limit: int = 50, offset: int = 0, most: int = ALL_PAGE) -> DataFrame:
    """One page in the order of example_ord."""
    return rows.orderBy("example_ord").offset(max(0, offset)).limit(min(max(1, limit), most))


def page_with_total(rows: DataFrame, limit: int = 50, offset: int = 0, most: int = ALL_PAGE) -> DataFrame:
    """One page, each of its rows with ``total``, the number of rows on all pages; the rows are counted apart from the top-k."""
    return page(rows, limit, offset, most).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def of_latest_jobs(rows: DataFrame, jobs: DataFrame, most: int = 100) -> DataFrame:
    """Rows of the ``most`` jobs that were made last; ``jobs(job_id, created_at, ord)``."""
    latest = jobs.orderBy(F.desc("created_at"), F.desc("ord")).limit(most).select("job_id")
    return rows.join(F.broadcast(latest), "job_id", "left_semi")


def ordered(rows: DataFrame, by: str = "score") -> DataFrame:
    """Rows by falling ``score``, by ``job`` or by ``type``; equal ones by example_ord."""
    keys = {"score": F.desc(F.coalesce("overall", F.lit(0.0))), "job": F.asc("job_id"), "type": F.asc("question_type")}
    return rows.orderBy(keys[by], "example_ord")


def selected_rows(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """The rows of ``selection(job_id, example_id, split)`` with the fields of a download."""
    fields = ("job_id", "split", "example_id", "source_doc", "question", "answer", "evidence", "question_type", "difficulty", "is_answerable", "overall", "accepted", "reason")
    return rows.join(selection.distinct(), ["job_id", "example_id", "split"], "left_semi").select(*[c for c in fields if c in rows.columns])


def job_metrics(rows: DataFrame, scores: tuple[str, ...] = ("relevance", "groundedness", "overall")) -> DataFrame:
    """``job_id, split, question_type, accepted, rejected``, and for each score of the accepted ``<score>_counts``: how often each value occurs, by value.

    A vector of scores follows from its counts (:func:`score_vector`), but they
    grow with the distinct values only and are summed before they are shuffled.
    Null scores count as none; a score that ``rows`` lacks has no counts.
    """
    by = ["job_id", "split", "question_type"]
    ok = F.col("reason").isNull()
    totals = rows.groupBy(*by).agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))
    given = F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("value")) for s in scores if s in rows.columns])
    counts = rows.where(ok).select(*by, F.explode(given).alias("s")).select(*by, "s.*").where("value is not null").groupBy(*by, "score", "value").agg(F.count("*").alias("n"))
    own = lambda s: F.array_sort(F.collect_list(F.when(F.col("score") == s, F.struct("value", "n")))).alias(f"{s}_counts")
    vectors = counts.groupBy(*by).agg(*map(own, scores))
    same = totals["job_id"].eqNullSafe(vectors["job_id"]) & totals["split"].eqNullSafe(vectors["split"]) & totals["question_type"].eqNullSafe(vectors["question_type"])
    none = F.array().cast("array<struct<value:double,n:bigint>>")
    return totals.join(vectors, same, "left").select(*[totals[c] for c in totals.columns], *[F.coalesce(vectors[f"{s}_counts"], none).alias(f"{s}_counts") for s in scores])


def score_vector(counts: Column) -> Column:
    """The scores that :func:`job_metrics` has counted, in order."""
    return F.flatten(F.transform(counts, lambda c: F.array_repeat(c["value"], c["n"].cast("int"))))


def stat_sums(per: DataFrame) -> DataFrame:
    """``job_id, accepted, rejected``: the sums over a job's splits."""
    return per.groupBy("job_id").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


def type_distribution(rows: DataFrame) -> DataFrame:
    """Per type: rows, and the mean score of those that have one."""
    return rows.groupBy(T.question_type(F.col("question_type")).alias("question_type")).agg(F.count("*").alias("n"), F.coalesce(F.bround(F.avg("overall"), 3), F.lit(0.0)).alias("avg_overall"))


def histogram(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Rows of each tenth of the score; empty bins are kept."""
    at = F.floor(F.least(F.greatest(F.col("overall"), F.lit(0.0)), F.lit(0.999)) * bins)
    counts = rows.where("overall is not null").groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(bins).select(F.col("id").alias("bin")).join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))

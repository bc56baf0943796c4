"""Train/eval split, quotas of question kinds, and the plan of what to generate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions import text as T
from sparkloom.operators.ranking import numbered
from sparkloom.sources.staging import staged

#: The order in which kinds are planned.
PLAN_ORDER = ("multi_chunk", "inferential", "unanswerable", "format_specific", "extractive")


def split_manifest(tokens: DataFrame, eval_ratio: float = 0.15) -> DataFrame:
    """``doc_id, tokens, split`` of ``tokens(doc_id, tokens)``: the largest documents, to ``eval_ratio`` of all, are eval.

    Of equal sizes the largest doc_id comes first. The cut is one row, a size
    and a doc_id, found from the sums over the distinct sizes and, where a size
    crosses the limit, the order of its documents; each row is compared with
    it, so the result reads ``tokens`` once and shuffles nothing. At least one
    document is train; a single one is. Ids may be of any type that has an
    order; rows that repeat an id and a size lie on one side. ``tokens`` is
    read to find the cut, so it should be a written table where it takes work
    to make. An empty table stays empty.
    """
    size = F.greatest(F.col("tokens"), F.lit(1)).cast("long")
    sizes = tokens.where("tokens is not null").groupBy("tokens").agg(F.count("*").alias("n"), (F.count("*") * size).alias("mass"))
    larger = Window.orderBy(F.desc("tokens")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = sizes.select(
        "tokens", "n", "mass", F.coalesce(F.sum("mass").over(larger), F.lit(0)).alias("before"), F.sum("mass").over(every).alias("total"),
        F.sum("n").over(every).alias("documents"), F.min("tokens").over(every).alias("smallest"),
    )
    target = F.greatest(F.lit(1), (F.col("total") * F.lit(eval_ratio)).cast("long"))
    cut = sums.where((F.col("before") < target) & (F.col("before") + F.col("mass") >= target)).withColumn("taken", F.ceil((target - F.col("before")) / size)).first()
    rows = tokens.where("tokens is not null")
    if cut is None:
        is_eval = F.lit(False)
    else:
        # the last document of all stays train
        taken = min(cut["taken"], cut["n"] - (cut["tokens"] == cut["smallest"]))
        same = F.col("tokens") == cut["tokens"]
        if cut["documents"] == 1:
            is_eval = F.lit(False)
        elif taken in (0, cut["n"]):
            is_eval = (F.col("tokens") > cut["tokens"]) | (same & F.lit(taken > 0))
        else:
            last = numbered(tokens.where(same).select("doc_id"), [], [F.desc("doc_id")]).where(F.col("place") == taken - 1).first()["doc_id"]
            is_eval = (F.col("tokens") > cut["tokens"]) | (same & (F.col("doc_id") >= F.lit(last)))
    return rows.select("doc_id", "tokens", F.when(is_eval, "eval").otherwise("train").alias("split"))


def kind_quota(totals: DataFrame, mix: dict[str, float] | None = None) -> DataFrame:
    """``total, kind, quota``: one of each kind if they all fit, the rest by largest remainder."""
    mix = {k: w for k, w in (mix or T.MIX).items() if w > 0} or {"extractive": 1.0}
    weight = sum(mix.values())
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(w / weight).alias("share")) for k, w in mix.items()])
    base = F.when(F.col("total") >= len(mix), 1).otherwise(0)
    rest = F.col("total") - base * len(mix)
    rows = totals.select("total", F.explode(kinds).alias("k")).select("total", "k.kind", base.alias("base"), rest.alias("rest"), (rest * F.col("k.share")).alias("exact"))
    rows = rows.withColumn("whole", F.floor("exact"))
    by_rest = Window.partitionBy("total").orderBy(F.desc(F.col("exact") - F.col("whole")), F.desc("kind"))
    left = F.col("rest") - F.sum("whole").over(Window.partitionBy("total"))
    return rows.select("total", "kind", (F.col("base") + F.col("whole") + (F.row_number().over(by_rest) <= left).cast("int")).cast("long").alias("quota"))


def chunk_scores(chunks: DataFrame) -> DataFrame:
    """``chunks`` with a score for each kind; needs ``text, tokens, n_neighbors, requires_multimodal``."""
    low = F.lower("text")
    numbers = F.size(F.filter(T.words(low), lambda w: w.rlike("[0-9]")))
    size = F.least(F.floor(F.col("tokens") / 1000), F.lit(5)).cast("int")
    images = F.coalesce(F.col("requires_multimodal"), F.lit(False)).cast("int")

    def mark(parts: tuple[str, ...]) -> Column:
        return T.has_any(low, parts).cast("int")

    return chunks.withColumns({
        "extractive": (1 + numbers + images + size).cast("long"), "inferential": (numbers + 2 * mark(T.COMPARISONS) + images + size).cast("long"),
        "unanswerable": (2 * mark(T.GAPS) + images + 2 * size).cast("long"), "multi_chunk": (F.col("n_neighbors") + size).cast("long"),
        "format_specific": (2 * mark(T.LISTS) + numbers + size).cast("long"),
    })


def target_plan(scored: DataFrame, per_chunk: int = 1, mix: dict[str, float] | None = None) -> DataFrame:
    """``batch, kind, pick, chunk_id``: the k-th pick of a kind is the chunk of rank ``k mod n`` in its batch.

    Needs ``batch, chunk_id, doc_id, chunk_ord, tokens`` and the kinds' scores;
    ids may be of any type that has an order. Chunks are first counted in cells
    (score, tokens), a small table that tells which cells a kind's quota
    reaches; only their chunks are put in order, by ranges, so no batch is
    sorted in one task.
    """
    key = ["batch", "chunk_id", "doc_id", "chunk_ord", "tokens"]
    sizes = scored.groupBy("batch").agg(F.count("*").alias("n"))
    total = F.greatest(F.lit(1), F.col("n") * per_chunk)
    quota = sizes.withColumn("total", total).join(kind_quota(sizes.select(total.alias("total")).distinct(), mix), "total").where("quota > 0").select("batch", "kind", "n", "quota")
    quota = staged(quota, "quotas")
    of_kind = lambda k: F.struct(F.lit(k).alias("kind"), F.col(k).alias("score"), F.col("tokens").alias("tokens"))
    kinds = F.array(*map(of_kind, PLAN_ORDER))
    cells = scored.select("batch", F.explode(kinds).alias("c")).groupBy("batch", "c").agg(F.count("*").alias("size")).select("batch", "c.*", "size")
    better = Window.partitionBy("batch", "kind").orderBy(F.desc("score"), F.desc("tokens")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("size").over(better), F.lit(0))).join(quota, ["batch", "kind"]).where(F.col("before") < F.least("quota", "n"))
    least = cells.groupBy("batch", "kind").agg(F.min(F.struct("score", "tokens")).alias("least")).groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("kind", "least"))).alias("least"))
    reached = F.filter(kinds, lambda c: F.struct(c["score"].alias("score"), c["tokens"].alias("tokens")) >= F.col("least")[c["kind"]])
    rows = scored.join(least, "batch").select(*key[:-1], F.explode(reached).alias("c")).select(*key[:-1], "c.*")
    ranked = numbered(rows, ["batch", "kind"], [F.desc("score"), F.desc("tokens"), F.col("doc_id"), F.col("chunk_ord")], "rank")
    picks = quota.select("batch", "kind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("pick"), "n").withColumn("rank", F.col("pick") % F.col("n"))
    return picks.join(ranked.select("batch", "kind", "rank", "chunk_id"), ["batch", "kind", "rank"]).select("batch", "kind", "pick", "chunk_id")


def existing_targets(examples: DataFrame) -> DataFrame:
    """``chunk_id, kind`` of examples that exist: the first chunk, and the kind asked for or else the type."""
    asked = F.coalesce(F.when(F.col("requested_kind") != "", F.col("requested_kind")), T.question_type(F.col("question_type")))
    return examples.where(F.size("chunk_ids") > 0).select(F.get("chunk_ids", F.lit(0)).alias("chunk_id"), asked.alias("kind"))


def selected_chunks(chunks: DataFrame, manifest: DataFrame, split: str, doc_ids: DataFrame | None = None, chunk_ids: DataFrame | None = None) -> DataFrame:
    """``chunks`` of the documents of a split, of these documents and these chunks only where given."""
    rows = chunks.join(manifest.where(F.col("split") == split).select("doc_id"), "doc_id", "left_semi")
    rows = rows if doc_ids is None else rows.join(doc_ids, "doc_id", "left_semi")
    return rows if chunk_ids is None else rows.join(chunk_ids, "chunk_id", "left_semi")


def kind_cycle(indexes: DataFrame, mix: dict[str, float] | None = None) -> DataFrame:
    """``index, kind``: kinds in turn, each as often as its weight has hundredths, once at least."""
    slots = [k for k, w in (mix or T.MIX).items() for _ in range(max(1, round(w * 100)))] or ["extractive"]
    return indexes.select("index", F.element_at(F.array(*map(F.lit, slots)), (F.col("index") % len(slots) + 1).cast("int")).alias("kind"))


def pending_targets(targets: DataFrame, existing: DataFrame) -> DataFrame:
    """``targets(ord, chunk_id, kind)`` without as many of each (chunk, kind) as ``existing`` holds."""
    done = existing.where("chunk_id is not null").groupBy("chunk_id", "kind").agg(F.count("*").alias("done"))
    nth = Window.partitionBy("chunk_id", "kind").orderBy("ord")
    return targets.withColumn("nth", F.row_number().over(nth)).join(done, ["chunk_id", "kind"], "left").where(F.col("nth") > F.coalesce("done", F.lit(0))).select("ord", "chunk_id", "kind")

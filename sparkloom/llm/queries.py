"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import chat_format, contamination, line_dedup, linear, mixing, near_dups, nearest, packing, phrases, quality, ranked, sanitise, token_counts, toxicity
from sparkloom.llm.common import shared_dir, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, with a cache that starts empty in each run."""
    import public_tokenizers

    cache = f"{shared_dir(spark)}/sparkloom-token-cache-{uuid.uuid4().hex}"
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache,
        ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, read back from the formatted text."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    out = chat_format.format_chats(turns).withColumn("turns", chat_format.read_back(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n"))), "")
    learnt = chat_format.loss_text(F.col("segments"))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "state", "valid",
    )


OP2_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(r, '&', '&amp;'), '<', '&lt;'), '|', '&#124;') AS er,
    replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '|', '&#124;') AS et,
    lag(r) OVER (PARTITION BY conv_id ORDER BY turn, r, t) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, r, t) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM c
), f AS (
  SELECT *, CASE WHEN k = 1 THEN r IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN r = 'user'
    WHEN before = 'user' THEN r = 'assistant' ELSE false END AS fits FROM e
), g AS (
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(length('<|' || er || '|>' || chr(10) || et || '<|end|>' || chr(10)))::BIGINT AS formatted_chars,
  CASE WHEN NOT bool_and(fits) THEN 'error' ELSE max(CASE WHEN k = n THEN CASE r WHEN 'system' THEN 'told' WHEN 'user' THEN 'asked' ELSE 'answered' END END) END AS state
FROM f GROUP BY conv_id)
SELECT *, state = 'answered' AS valid FROM g
"""

def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = line_dedup.duplicate_lines(docs).groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    return docs.select("doc_id").join(gone, "doc_id", "left").select(
        "doc_id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join("lines", ","), F.lit("")).alias("dropped_lines"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", linear.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination.report(contamination.find_contamination(docs, table(spark, sf_dir, "benchmark")))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), n AS (SELECT DISTINCT len(win) AS k FROM bw
), dw AS (
  SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, n WHERE len(w) >= k)
), m AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (win)
), h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""".replace("\\\\", "\\")


def op6_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise.sanitise(table(spark, sf_dir, "documents"))
    base = {k: k for k in sanitise.KINDS}
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in sanitise.KINDS]
    return out.select("doc_id", *counts, F.sha2(sanitise.joined_spans(base), 256).alias("base_sha256"), sanitise.joined_spans(base | {"term": "terms"}).alias("spans"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2048 tokens, counted as op1 does."""
    import public_tokenizers

    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    special = token_counts.special_tokens(path)
    return packing.pack(packing.packable(table(spark, sf_dir, "documents"), lambda: token_counts.counter(path, ranks, special)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", linear.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), percent=85, words=3)


def op10_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(rows, mixed)


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT doc_id, unnest(ls) AS h, unnest(range(0, len(ls))) AS k FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
), l AS (
  SELECT doc_id, k, regexp_replace({_LOWER.format('h')}, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS t FROM raw
), u AS (
  SELECT t, row_number() OVER (ORDER BY f) AS i, strlen(t) AS n FROM (SELECT t, min({{'d': doc_id, 'k': k}}) AS f FROM l WHERE t <> '' GROUP BY t)
), g AS (SELECT *, unnest([n - 2, n - 1, n, n + 1, n + 2]) AS m FROM u WHERE n >= 20
), h AS (SELECT a.i AS x, b.i AS y FROM g a JOIN u b ON a.m = b.n AND a.i < b.i AND b.n >= 20 WHERE levenshtein(a.t, b.t) <= 2
), e AS (SELECT x, y FROM h UNION ALL SELECT y, x FROM h
), c AS (SELECT i AS v, i AS m FROM u UNION SELECT e.y, c.m FROM c JOIN e ON e.x = c.v
), s AS (SELECT t, min(m) AS class FROM c JOIN u ON u.i = c.v GROUP BY t
), o AS (SELECT doc_id, k, row_number() OVER (PARTITION BY class ORDER BY doc_id, k) AS nth FROM l JOIN s USING (t)
), d AS (SELECT doc_id, count(*) AS n, string_agg(k::VARCHAR, ',' ORDER BY k) AS ks FROM o WHERE nth > 1 GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_dropped, coalesce(ks, '') AS dropped_lines FROM documents LEFT JOIN d USING (doc_id)
"""

OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS s FROM d
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), c AS (SELECT doc_id AS v, doc_id AS m FROM documents UNION SELECT f.b, c.m FROM c JOIN f ON f.a = c.v
), r AS (SELECT v AS doc_id, min(m) AS component_id FROM c GROUP BY v)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM r LEFT JOIN n USING (doc_id)
"""

OP10_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), u AS (
  SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
  FROM u q JOIN u c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP11_SQL = f"""
WITH p AS (
  SELECT lang, w FROM (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)) WHERE len(w) > 0
), g AS (
  SELECT lang, w[i:i + m - 1] AS ph, count(*) AS f FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m) GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE len(ph) = 1 GROUP BY lang
), c AS (SELECT lang, ph, f AS a, unnest(range(1, len(ph))) AS k FROM g WHERE len(ph) > 1 AND f >= 10
), s AS (
  SELECT c.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c JOIN g x ON x.lang = c.lang AND x.ph = c.ph[1:k] JOIN g y ON y.lang = c.lang AND y.ph = c.ph[k + 1:]
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1
), o AS (SELECT DISTINCT lang, ph[i:i + 1] AS ph, a FROM (SELECT lang, ph, a, unnest([1, 2]) AS i FROM c WHERE len(ph) = 3)
), kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.ph = b.ph AND 100 * o.a >= 50 * b.a)
), t AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, score FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score FROM t JOIN n USING (lang) QUALIFY rank <= 2000
"""

OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), c AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM d
), tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), s AS (
  SELECT item_id, doc_id, sum(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), c GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_chat_format": op2_chat_format,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_sanitisation": op6_sanitisation,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality": op8_quality,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_vantage_point_search": op10_vantage_point_search,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_ranked_search": op12_ranked_search,
    "op13_source_mixing": op13_source_mixing,
}
SQL = {
    "op2_chat_format": OP2_SQL,
    "op5_decontamination": OP5_SQL,
    "op3_line_dedup": OP3_SQL,
    "op9_minhash_near_dedup": OP9_SQL,
    "op10_vantage_point_search": OP10_SQL,
    "op11_phrase_mining": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
}

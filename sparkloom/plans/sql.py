"""The queries in SQL, for engines that read the same Parquet tables (DuckDB's dialect)."""

from __future__ import annotations

from sparkloom.functions import text as T
from sparkloom.plans.base_sql import TITLE, UPPER, any_of, sq, strip, w

TOKENS = f"tok AS (SELECT doc_id, len({w('text')})::BIGINT AS tokens FROM documents)"
PAGED = f"""
ln AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents),
pg AS (SELECT doc_id, source, k + 1 AS page_no, {sq("array_to_string(list_slice(l, k * 5 + 1, k * 5 + 5), ' ')")} AS page_text
  FROM (SELECT *, unnest(range(0, (len(l) - 1) // 5 + 1)) AS k FROM ln)),
np AS (SELECT doc_id, source, max(page_no) AS page_count FROM pg GROUP BY ALL)"""
CHUNKS = PAGED + """,
cw AS (SELECT doc_id, source, (page_no - 1) // 4 AS k, min(page_no) AS page_start, max(page_no) AS page_end,
  string_agg(page_text, chr(10) || chr(10) ORDER BY page_no) FILTER (page_text <> '') AS text FROM pg GROUP BY ALL),
co AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_ord FROM cw WHERE text IS NOT NULL),
ch AS (SELECT *, 'doc-' || doc_id || '-chunk-' || lpad(chunk_ord::VARCHAR, greatest(4, length(chunk_ord::VARCHAR))::INT, '0') || '-' ||
  substr(sha1('doc-' || doc_id || '-' || chunk_ord || '-' || page_start), 1, 12) AS chunk_id FROM co)"""
MANIFEST = TOKENS + """,
ru AS (SELECT *, sum(greatest(tokens, 1)) OVER (ORDER BY tokens DESC, doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  row_number() OVER (ORDER BY tokens DESC, doc_id DESC) AS rn, count(*) OVER () AS n, sum(greatest(tokens, 1)) OVER () AS total FROM tok),
ma AS (SELECT doc_id, tokens, CASE WHEN coalesce(before, 0) < greatest(1, floor(total * 0.15::DOUBLE)) AND rn < n THEN 'eval' ELSE 'train' END AS split FROM ru)"""
_QUOTA = " UNION ALL ".join(f"SELECT '{k}' AS kind, {x / sum(T.MIX.values())!r}::DOUBLE AS share" for k, x in T.MIX.items())


def quota(totals: str) -> str:
    return f"""
mx AS ({_QUOTA}),
qe AS (SELECT total, kind, CASE WHEN total >= 5 THEN 1 ELSE 0 END AS base, total - CASE WHEN total >= 5 THEN 5 ELSE 0 END AS rest,
  (total - CASE WHEN total >= 5 THEN 5 ELSE 0 END) * share AS exact FROM ({totals}), mx),
qu AS (SELECT total, kind, (base + floor(exact) + CASE WHEN row_number() OVER (PARTITION BY total ORDER BY exact - floor(exact) DESC, kind DESC)
  <= rest - sum(floor(exact)) OVER (PARTITION BY total) THEN 1 ELSE 0 END)::BIGINT AS quota FROM qe)"""


SCORED = CHUNKS + f""",
sc AS (SELECT *, len({w('text')})::BIGINT AS tokens, len(list_filter({w('lower(text)')}, lambda x: regexp_matches(x, '[0-9]'))) AS num, lower(text) AS low,
  (chunk_ord > 0)::BIGINT + (chunk_ord < max(chunk_ord) OVER (PARTITION BY doc_id))::BIGINT AS around, {any_of('text', T.FORMULA_MARKERS)}::INT AS mm FROM ch),
ss AS (SELECT *, least(tokens // 1000, 5) AS size FROM sc),
sx AS (SELECT chunk_id, source AS batch, tokens, doc_id, chunk_ord, (1 + num + mm + size)::BIGINT AS extractive,
  (num + 2 * {any_of('low', T.COMPARISONS)}::INT + mm + size)::BIGINT AS inferential, (2 * {any_of('low', T.GAPS)}::INT + mm + 2 * size)::BIGINT AS unanswerable,
  (around + size)::BIGINT AS multi_chunk, (2 * {any_of('low', T.LISTS)}::INT + num + size)::BIGINT AS format_specific FROM ss)"""
_KIND = "list_extract(['" + "', '".join(T.KINDS) + "'], ((conv_id * 8 + turn) % 5 + 1)::INT)"
EXAMPLES = f"""
pr AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations),
ex0 AS (SELECT 2 * (conv_id * 1000000 + turn) AS example_ord, conv_id AS doc_id, 'job-' || conv_id % 5 AS job_id, {_KIND} AS requested_kind,
  CASE WHEN (conv_id + turn) % 17 = 0 THEN 'factoid' ELSE {_KIND} END AS question_type, 'doc-' || conv_id || '-chunk-' || turn AS c1, text AS question,
  CASE WHEN {_KIND} = 'unanswerable' AND conv_id % 3 <> 0 THEN '{T.REFUSAL}' ELSE reply END AS answer, {_KIND} <> 'unanswerable' AS is_answerable, conv_id % 11 <> 0 AS has_evidence,
  CASE WHEN conv_id % 13 <> 0 THEN (50 + (conv_id * 31 + turn * 17) % 51) / 100.0::DOUBLE END AS overall,
  CASE WHEN conv_id % 13 <> 0 THEN (50 + (conv_id * 13 + turn * 29) % 51) / 100.0::DOUBLE END AS groundedness
  FROM pr WHERE role = 'user' AND nr = 'assistant'),
ex1 AS (SELECT * FROM ex0 UNION ALL SELECT * REPLACE (example_ord + 1 AS example_ord) FROM ex0 WHERE doc_id % 7 = 0),
ex AS (SELECT *, CASE WHEN requested_kind = 'multi_chunk' THEN [c1, c1 || 'b'] ELSE [c1] END AS chunk_ids, CASE WHEN question_type = 'factoid' THEN 'extractive' ELSE question_type END AS kind, 'doc-' || doc_id || '.pdf' AS source_doc FROM ex1)"""
CURATED = MANIFEST + "," + EXAMPLES + f""",
ei AS (SELECT ex.*, ma.split, substr(sha1(array_to_string(chunk_ids, '|') || '|' || question), 1, 12) AS example_id FROM ex JOIN ma USING (doc_id)),
ow AS (SELECT *, doc_id || '|' || lower({strip('question')}) || '|' || lower({strip('answer')}) AS fp, CASE WHEN is_answerable AND NOT has_evidence THEN 'missing_evidence'
  WHEN kind <> requested_kind THEN 'question_type_mismatch' WHEN NOT is_answerable AND {strip('answer')} <> '{T.REFUSAL}' THEN 'invalid_refusal'
  WHEN overall IS NULL THEN 'missing_judge_score' WHEN groundedness < 0.7 THEN 'low_groundedness' WHEN overall < 0.7 THEN 'low_overall' END AS own FROM ei),
cu AS (SELECT *, CASE WHEN example_ord > min(example_ord) FILTER (own IS NULL) OVER (PARTITION BY fp) THEN 'duplicate' ELSE own END AS reason FROM ow)"""
EVENTS = """ev AS (SELECT event_id, 'job-' || user_id AS job_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running'
  WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE event_type END AS status, least(value / 500.0, 1.0)::DOUBLE AS percent, props AS message FROM events)"""

_NORMAL = sq(r"regexp_replace(text, '([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)', '\1\2', 'g')")

SQL = {
    "normalize_text": f"SELECT doc_id, sha1({_NORMAL}) AS text_hash, length({_NORMAL})::BIGINT AS n_chars FROM documents",
    "doc_token_counts": f"WITH {TOKENS} SELECT * FROM tok",
    "doc_ids": "SELECT doc_id, 'doc-' || doc_id || '-' || substr(sha1('/corpus/' || source || '/Doc ' || doc_id || '.pdf'), 1, 10) AS document FROM documents",
    "page_assets": f"WITH {PAGED} SELECT doc_id, page_no, length(page_text)::BIGINT AS text_chars, {any_of('page_text', T.FORMULA_MARKERS)} AS visual, {any_of('page_text', T.FORMULA_MARKERS)} OR length(page_text) < 80 AS requires_multimodal FROM pg",
    "parser_guard": f"WITH {PAGED} SELECT doc_id, page_count, CASE WHEN page_count > 3 THEN 'docling_max_pages' WHEN 4096 - doc_id % 3000 < 3072 THEN 'docling_max_ram_mb' END AS skip_reason FROM np",
    "heading_lines": rf"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents), t AS (SELECT doc_id, line_no, regexp_replace(raw, '^[ \t\r]+|[ \t\r]+$', '', 'g') AS h FROM l) SELECT doc_id, line_no, h AS heading FROM t WHERE h <> '' AND len({w('h')}) <= 8 AND ({TITLE} OR {UPPER} OR h LIKE '#%')",
    "word_window_chunks": f"WITH t AS (SELECT doc_id, {w('text')} AS ws FROM documents), c AS (SELECT doc_id, ws, unnest(range(0, CASE WHEN len(ws) <= 128 THEN 1 ELSE 1 + ceil((len(ws) - 128) / 112.0)::BIGINT END)) AS k FROM t WHERE len(ws) > 0) SELECT doc_id, k AS chunk_ord, len(list_slice(ws, k * 112 + 1, k * 112 + 128))::BIGINT AS n_words, sha1(array_to_string(list_slice(ws, k * 112 + 1, k * 112 + 128), ' ')) AS text_hash FROM c",
    "page_limit_chunks": f"WITH {CHUNKS} SELECT doc_id, chunk_id, chunk_ord, page_start, page_end, sha1(text) AS text_hash FROM ch",
    "chunk_coverage": f"WITH {CHUNKS}, cc AS (SELECT doc_id, count(*) AS chunk_count, sum(page_end - page_start + 1)::BIGINT AS pages_covered FROM ch GROUP BY doc_id) SELECT doc_id, page_count, coalesce(pages_covered, 0) AS pages_covered, round_even(coalesce(pages_covered, 0) / page_count, 4)::DOUBLE AS coverage_ratio, coalesce(chunk_count, 0) AS chunk_count, CASE WHEN page_count <= 1 THEN 1 ELSE greatest(2, ceil(page_count / 20.0)) END::BIGINT AS expected_min_chunks FROM np LEFT JOIN cc USING (doc_id)",
    "chunk_neighbors": f"WITH {CHUNKS} SELECT chunk_id, coalesce(concat_ws(',', lag(chunk_id) OVER o, lead(chunk_id) OVER o), '') AS neighbors FROM ch WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_ord)",
    "split_manifest": f"WITH {MANIFEST} SELECT * FROM ma",
    "kind_quota": f"WITH {TOKENS}, {quota('SELECT DISTINCT tokens AS total FROM tok WHERE tokens IS NOT NULL')} SELECT * FROM qu",
    "chunk_scores": f"WITH {SCORED} SELECT chunk_id, tokens, multi_chunk, inferential, unanswerable, format_specific, extractive FROM sx",
    "target_plan": f"WITH {SCORED}, bn AS (SELECT batch, count(*) AS n FROM sx GROUP BY batch), {quota('SELECT DISTINCT n AS total FROM bn')}, lo AS (UNPIVOT sx ON extractive, inferential, unanswerable, multi_chunk, format_specific INTO NAME kind VALUE score), rk AS (SELECT batch, kind, chunk_id, row_number() OVER (PARTITION BY batch, kind ORDER BY score DESC, tokens DESC, doc_id, chunk_ord) - 1 AS rank FROM lo), pk AS (SELECT batch, kind, n, unnest(range(0, quota)) AS pick FROM bn JOIN qu ON total = n) SELECT batch, kind, pick, chunk_id FROM pk JOIN rk USING (batch, kind) WHERE rank = pick % n",
    "pending_targets": f"WITH {EXAMPLES}, d AS (SELECT c1, CASE WHEN doc_id % 8 = 0 THEN requested_kind ELSE kind END AS requested_kind, count(*) AS done FROM ex WHERE doc_id % 4 = 0 AND example_ord % 2 = 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c1, requested_kind ORDER BY example_ord) AS nth FROM ex) SELECT example_ord AS ord, c1 AS chunk_id, requested_kind AS kind FROM r LEFT JOIN d USING (c1, requested_kind) WHERE nth > coalesce(done, 0)",
    "pending_chunks": f"WITH {EXAMPLES} SELECT DISTINCT c1 AS chunk_id FROM ex WHERE c1 NOT IN (SELECT c1 FROM ex WHERE doc_id % 4 = 0)",
    "question_types": f"WITH {CURATED} SELECT question_type, kind, count(*) AS n FROM ei GROUP BY ALL",
    "example_ids": f"WITH {CURATED} SELECT example_ord, example_id FROM ei",
    "evidence_resolution": f"WITH {CURATED}, e AS (SELECT *, {strip('answer')} AS a, {strip('question')} AS q FROM ei), g AS (SELECT *, list_filter([CASE WHEN has_evidence AND a <> '' AND NOT (lower(a) LIKE 'fragmento %' OR lower(a) IN ('fragmento', 'evidence', 'evidencia')) THEN a END, 'fragmentos', nullif(q, '')], lambda x: x IS NOT NULL) AS l, list_filter([CASE WHEN has_evidence AND a <> '' THEN answer END, ' Fragmento 2', 'EVIDENCIA', 'fragmentos'], lambda x: x IS NOT NULL) AS f FROM e), r AS (SELECT example_ord, CASE WHEN is_answerable THEN list_filter(l, lambda x, i: list_position(l, x) = i) ELSE f END AS ev FROM g) SELECT example_ord, len(ev)::BIGINT AS n_evidence, sha1(array_to_string(ev, '|')) AS evidence_hash FROM r",
    "curation_reasons": f"WITH {CURATED} SELECT example_ord, reason FROM cu",
    "curation_summary": f"WITH {CURATED} SELECT split, coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM cu GROUP BY ALL",
    "training_records": f"""WITH {CURATED} SELECT example_ord, sha1('system:{T.SYSTEM_PROMPT.replace(chr(39), chr(39) * 2)}' || chr(10) || 'user:' || question || chr(10) || 'assistant:' || answer) AS messages_hash, example_id, source_doc, doc_id::VARCHAR AS doc_id,
  array_to_string(chunk_ids, ',') AS chunk_ids, (doc_id % 7 + 1) || '-' || (doc_id % 7 + 2) AS page_range, kind AS question_type, CASE WHEN doc_id % 2 = 0 THEN 'medium' ELSE 'hard' END AS difficulty, is_answerable,
  'echo' AS teacher_model, 'echo' AS judge_model, coalesce(overall, 0.0)::DOUBLE AS quality_score, split, 'v1' AS prompt_version, 'en' AS language FROM cu WHERE reason IS NULL""",
    "review_sample": f"WITH {CURATED} SELECT example_ord, example_id, kind AS question_type, coalesce(overall, 0.0)::DOUBLE AS quality_score, split FROM cu WHERE reason IS NULL ORDER BY cu.question_type, coalesce(overall, 0), example_id, example_ord LIMIT 100",
    "report_counts": f"WITH {CURATED} SELECT split, count(*) AS generated, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected, count(DISTINCT doc_id) AS documents FROM cu GROUP BY split",
    "examples_filtered_page": f"WITH {CURATED} SELECT example_ord, example_id, overall FROM cu WHERE reason IS NULL AND split = 'train' AND lower(question_type) = 'extractive' AND coalesce(overall, 0) >= 0.75 ORDER BY example_ord LIMIT 25 OFFSET 2",
    "examples_search": f"WITH {CURATED} SELECT example_ord, question_type FROM cu WHERE contains(lower(question), 'oc-1') OR contains(lower(answer), 'oc-1') OR contains(lower(source_doc), 'oc-1')",
    "type_distribution": f"WITH {CURATED} SELECT kind AS question_type, count(*) AS n, coalesce(round_even(avg(overall), 3), 0.0)::DOUBLE AS avg_overall FROM cu WHERE coalesce(overall, 0) >= 0.5 GROUP BY kind",
    "per_job_counts": f"WITH {CURATED} SELECT job_id, split, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected FROM cu GROUP BY ALL",
    "score_histogram": f"WITH {CURATED}, h AS (SELECT floor(least(greatest(overall, 0), 0.999) * 10)::BIGINT AS bin, count(*) AS n FROM cu WHERE reason IS NULL AND overall IS NOT NULL GROUP BY 1) SELECT b.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 10)) AS bin) b LEFT JOIN h ON b.bin = h.bin",
    "editor_accept": f"""WITH {CURATED}, ids AS (SELECT DISTINCT example_id FROM cu WHERE doc_id % 5 = 0), f AS (SELECT example_id, bool_or(reason IS NULL) AS has, max(example_ord) AS last FROM cu JOIN ids USING (example_id) GROUP BY 1)
SELECT example_ord, CASE WHEN NOT has THEN NULL ELSE reason END AS reason, CASE WHEN NOT has AND overall IS NULL THEN 0.8::DOUBLE ELSE overall END AS overall FROM cu LEFT JOIN f USING (example_id) WHERE has IS NULL OR has OR example_ord = last""",
    "editor_reject": f"""WITH {CURATED}, ids AS (SELECT DISTINCT example_id FROM cu WHERE doc_id % 3 = 0), f AS (SELECT example_id, max(example_ord) FILTER (reason IS NULL) AS last FROM cu JOIN ids USING (example_id) GROUP BY 1)
SELECT example_ord, CASE WHEN reason IS NULL AND example_ord = last THEN 'manual_rejection' ELSE reason END AS reason FROM cu LEFT JOIN f USING (example_id) WHERE last IS NULL OR reason IS NOT NULL OR example_ord = last""",
    "job_latest_state": f"WITH {EVENTS} SELECT job_id, max(event_id) AS event_id, arg_max(status, event_id) AS status, arg_max(percent, event_id) AS percent, arg_max(message, event_id) AS message, count(*) AS n_events FROM ev GROUP BY job_id",
    "active_job": f"WITH {EVENTS}, f AS (SELECT job_id, min(event_id) AS first_event, arg_max(status, event_id) AS status FROM ev GROUP BY job_id) SELECT * FROM f WHERE status IN ('queued', 'running', 'pausing', 'paused', 'resuming') ORDER BY first_event LIMIT 1",
    "event_tail": f"WITH {EVENTS} SELECT event_id, job_id, status FROM ev WHERE event_id > 500",
    "retry_backoff": "SELECT i AS attempt, CASE WHEN i % 5 = 0 THEN 7.0 ELSE least(0.25 * pow(2, i - 1), 30) END::DOUBLE AS wait_s FROM (SELECT event_id % 12 + 1 AS i FROM events)",
    "breaker_failure_rate": f"WITH {EVENTS}, o AS (SELECT *, (status = 'failed')::INT AS failed FROM ev WHERE status IN ('completed', 'failed')) SELECT event_id, job_id, round_even(avg(failed) OVER r, 3)::DOUBLE AS failure_rate, count(*) OVER r >= 5 AND avg(failed) OVER r >= 0.5 AS tripped FROM o WINDOW r AS (PARTITION BY job_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
}

"""SQL (DuckDB's dialect) of the queries on neighbours, generation, reports, edits and jobs; ``SQL`` has all queries'."""

from __future__ import annotations

from sparkloom.functions import text as T
from sparkloom.operators import generation as G
from sparkloom.operators import jobs as J
from sparkloom.operators import reporting as R
from sparkloom.plans import semantic_sql, sql
from sparkloom.plans.base_sql import any_of, strip
from sparkloom.plans.base_sql import sq, w
from sparkloom.plans.semantic_sql import q
from sparkloom.plans.sql import CHUNKS, CURATED, EVENTS, MANIFEST, PAGED, SCORED

NL = "chr(10)"
SETS = f"list_distinct(list_transform(list_filter({w('text')}, lambda x: length(x) > 2), lambda x: lower(x)))"
LEXICAL = CHUNKS + f""",
lx AS (SELECT doc_id, chunk_id, chunk_ord, {SETS} AS ws, count(*) OVER (PARTITION BY doc_id) AS n FROM ch),
le AS (SELECT e.chunk_id, arg_min(o.chunk_id, o.chunk_ord) AS extra FROM lx e JOIN lx o ON e.doc_id = o.doc_id AND abs(e.chunk_ord - o.chunk_ord) > 1 AND e.chunk_ord IN (0, e.n - 1) AND list_has_any(e.ws, o.ws) GROUP BY 1)"""
BATCHES = MANIFEST + "," + CHUNKS + """,
bo AS (SELECT split, doc_id, chunk_id, page_start AS a, page_end AS b, row_number() OVER (PARTITION BY split ORDER BY doc_id, chunk_ord) AS k FROM ch JOIN ma USING (doc_id)),
bf AS (SELECT split, doc_id, chunk_id, k, b - a + 1 AS pages, b AS seen, 0 AS batch_no FROM bo WHERE k = 1 UNION ALL
  SELECT split, doc_id, chunk_id, k, CASE WHEN fresh THEN b - a + 1 ELSE pages + more END, greatest(b, CASE WHEN fresh THEN 0 ELSE seen END), batch_no + fresh::INT FROM (
    SELECT *, pages > 0 AND pages + more > 50 AS fresh FROM (SELECT bo.*, pages, batch_no, CASE WHEN bo.doc_id = bf.doc_id THEN bf.seen ELSE 0 END AS seen,
      greatest(b - greatest(a - 1, CASE WHEN bo.doc_id = bf.doc_id THEN bf.seen ELSE 0 END), 0) AS more FROM bf JOIN bo ON bo.split = bf.split AND bo.k = bf.k + 1)))"""
DENSE = PAGED + f""",
dw AS (SELECT doc_id, greatest(1, page_count // CASE WHEN page_count <= 1 THEN 1 ELSE greatest(2, ceil(page_count / 2.0)::BIGINT) END)::BIGINT AS width FROM np),
dg AS (SELECT doc_id, (page_no - 1) // width AS k, min(page_no) AS page_start, max(page_no) AS page_end, string_agg(page_text, {NL} || {NL} ORDER BY page_no) FILTER (page_text <> '') AS text FROM pg JOIN dw USING (doc_id) GROUP BY ALL)"""
_PLAN, _END = sql.SQL["target_plan"].removeprefix("WITH ").rsplit(" SELECT batch, kind, pick, chunk_id FROM", 1)
ABOUT = f"""
cq AS (SELECT *, source AS batch, {{'a': doc_id, 'b': chunk_ord}} AS chunk_seq FROM ch),
cn AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY chunk_seq) AS nth FROM cq),
lb AS (SELECT batch, 'Pages ' || page_start || '-' || page_end AS label, min(chunk_seq) AS seq FROM cq GROUP BY ALL),
ls AS (SELECT batch, array_to_string((list(label ORDER BY seq))[1:{G.HEADINGS}], '; ') AS labels FROM lb GROUP BY batch),
ab AS (SELECT batch, arg_min(doc_id, nth) AS doc, count(*) AS n, array_to_string(({w("string_agg(text, ' ' ORDER BY nth)")})[1:{G.PREVIEW_WORDS}], ' ') AS preview,
  substr(string_agg(text, {NL} || {NL} ORDER BY nth), 1, {G.CONTEXT_CHARS}) AS context FROM cn GROUP BY batch),
su AS (SELECT batch, context, 'Document: doc-' || doc || {NL} || 'Chunk count: ' || n || {NL} || 'Structure: ' || labels || CASE WHEN preview <> '' THEN {NL} || 'Preview: ' || preview ELSE '' END AS summary FROM ab JOIN ls USING (batch))"""


def _fragment(k: int, c: str) -> str:
    return f"'FRAGMENT {k}' || {NL} || 'Section: ' || {NL} || 'Doc: doc-' || {c}.doc_id || {NL} || 'Pages: ' || {c}.page_start || '-' || {c}.page_end || {NL} || {c}.text"


_RULE = " ".join(f"WHEN '{k}' THEN {q(x)}" for k, x in G.RULES.items())
_HARD = (G.UNANSWERABLE_NOTE + f"\nIf is_answerable is false the answer MUST be exactly: '{T.REFUSAL}'.").replace("'", "''")
PROMPTS = f"""{_PLAN}, tp AS (SELECT batch, kind, pick, chunk_id FROM{_END}), {ABOUT},
nb AS (SELECT *, coalesce(lag(chunk_id) OVER o, lead(chunk_id) OVER o) AS near FROM ch WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_ord)),
cx AS (SELECT tp.*, c.doc_id, c.text AS t1, o.text AS t2, o.chunk_id AS c2, c.page_start, coalesce(o.page_end, c.page_end) AS page_end, {_fragment(1, 'c')} AS f1, {_fragment(2, 'o')} AS f2,
  CASE WHEN kind = 'multi_chunk' AND o.chunk_id IS NULL THEN 'inferential' ELSE kind END AS asked FROM tp JOIN nb c USING (chunk_id) LEFT JOIN nb o ON kind = 'multi_chunk' AND o.chunk_id = c.near),
pm AS (SELECT *, {q(G.TEACHER)} || '\nOutput language: English (en). Reply ONLY in English.\nRequired question type: ''' || asked || '''. The field question_type must equal ''' || asked || '''.\n' || CASE asked {_RULE} END
  || CASE WHEN asked = 'unanswerable' THEN '{_HARD}' ELSE '' END AS system,
  'DOCUMENT OVERVIEW:\n' || summary || CASE WHEN asked = 'unanswerable' THEN '\n\nFULL DOCUMENT CONTEXT:\n' || context ELSE '' END || '\n\n{"=" * 60}\n\n' || f1 || coalesce({NL} || {NL} || f2, '') AS "user" FROM cx JOIN su USING (batch))"""
GENERATED = PROMPTS + f""",
ga AS (SELECT *, array_to_string(({w(f"t1 || coalesce({NL} || {NL} || f2, '')")})[1:12], ' ') AS quote, 'What is said in ' || chunk_id || '?' AS question, CASE WHEN c2 IS NULL THEN [chunk_id] ELSE [chunk_id, c2] END AS ids FROM pm),
ge AS (SELECT *, CASE WHEN asked = 'unanswerable' THEN '{T.REFUSAL}' ELSE quote END AS answer, CASE WHEN asked = 'unanswerable' THEN [quote, 'FRAGMENTO 1'] ELSE
  list_filter([quote, CASE WHEN trim(t1) <> quote THEN trim(t1) END, CASE WHEN trim(t2) NOT IN (quote, trim(t1)) THEN trim(t2) END], lambda x: x IS NOT NULL) END AS evidence FROM ga)"""
_JUDGED = f"""{q(G.JUDGE[0])} || 'English (en){G.JUDGE[1]}' || 'QUESTION:\n' || question || '\n\nANSWER:\n' || answer || '\n\nEVIDENCE:\n' || array_to_string(list_transform(evidence, lambda e: '- ' || e), {NL}) || '\n\n{G.JUDGE_TASK}'"""
_NUMBERS = ", ".join(f"try_cast(json_extract_string(j, '$.{s}') AS DOUBLE) AS {s}" for s in G.SCORES)
_FINE = " AND ".join(f"{s} IS NOT NULL" for s in (*G.SCORES, "rationale"))
MODE = MANIFEST + f""",
mc AS (SELECT count(DISTINCT doc_id) AS documents, count(*) FILTER (split = 'eval') > 0 AS has_eval FROM ma),
mo AS (SELECT CASE WHEN documents = 1 THEN 'single_document' ELSE 'multi_document' END AS mode, {", ".join(f"CASE WHEN documents = 1 THEN {q(R.MODES['single_document'][k])} ELSE {q(R.MODES['multi_document'][k])} END AS {n}" for k, n in enumerate(("label", "note", "aptitude")))},
  documents, documents <> 1 AND has_eval AS clean_eval FROM mc)"""
_MODE = MODE[len(MANIFEST) + 1:]
_RUN = f"SELECT run_id, {list(J.PHASES)!r}[1:(run_id % 8)::INT] AS completed, run_id % 24 < 16 AS resume, CASE WHEN run_id % 5 = 4 THEN run_id % 8 END AS start FROM (SELECT event_id AS run_id FROM events)"
_LANGS = list(T.FUNCTION_WORDS)
_HITS = ", ".join(f"len(list_filter(ws, lambda x: list_contains({list(T.FUNCTION_WORDS[k])!r}, x)))" for k in _LANGS)

_EDGES = rf"""rn AS (SELECT doc_id, source, unnest(l) AS raw, unnest(range(0, len(l))) AS line_no FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
fl AS (SELECT *, {strip('raw')} AS t, line_no // 5 AS page FROM rn WHERE {strip('raw')} <> ''),
fe AS (SELECT *, line_no = min(line_no) OVER (PARTITION BY doc_id, page) AS is_head, line_no = max(line_no) OVER (PARTITION BY doc_id, page) AS is_foot FROM fl),
ed AS (SELECT doc_id, source, line_no, edge, regexp_replace(t, '[0-9]+', '#', 'g') AS line FROM (SELECT *, 'head' AS edge FROM fe WHERE is_head UNION ALL SELECT *, 'foot' AS edge FROM fe WHERE is_foot)),
ru AS (SELECT *, sum(n) OVER (PARTITION BY source, edge)::BIGINT AS pages FROM (SELECT source, edge, line, count(*) AS n FROM ed GROUP BY ALL))"""

SQL = sql.SQL | semantic_sql.SQL | {
    "lexical_neighbors": f"WITH {LEXICAL} SELECT chunk_id, concat_ws(',', lag(chunk_id) OVER o, lead(chunk_id) OVER o, extra) AS neighbors FROM lx LEFT JOIN le USING (chunk_id) WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_ord)",
    "page_batches": f"WITH RECURSIVE {BATCHES} SELECT split, doc_id, chunk_id, batch_no::BIGINT AS batch_no FROM bf",
    "coverage_fallback": f"WITH RECURSIVE {semantic_sql.CHUNKS}, pc AS (SELECT doc_id, (len(string_split(text, chr(10))) - 1) // 5 + 1 AS page_count, len({w('text')}) AS tokens FROM documents), cl AS (SELECT doc_id, count(*) AS n, max(page_end) AS last FROM sc GROUP BY doc_id) SELECT doc_id, CASE WHEN n IS NULL THEN TRUE WHEN page_count <= 1 THEN FALSE WHEN last < page_count THEN TRUE WHEN tokens > 256 THEN n = 1 OR n < 1 + ceil((tokens - 256) / 224.0) ELSE FALSE END AS fallback FROM pc LEFT JOIN cl USING (doc_id)",
    "dense_windows": f"WITH {DENSE} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_ord, page_start, page_end, sha1(text) AS text_hash FROM dg WHERE text IS NOT NULL",
    "chunk_summaries": f"WITH {CHUNKS}, {ABOUT} SELECT batch, summary, sha1(context) AS context_hash FROM su",
    "generation_prompts": f"WITH {PROMPTS} SELECT batch, kind, pick, chunk_id, asked, sha1(system) AS system_hash, sha1(\"user\") AS user_hash FROM pm",
    "generated_examples": f"WITH {GENERATED} SELECT batch, kind, pick, chunk_id, substr(sha1(array_to_string(ids, '|') || '|' || question), 1, 12) AS example_id, asked AS question_type, asked <> 'unanswerable' AS is_answerable, asked = kind AS matches, CASE WHEN asked <> kind THEN 3 WHEN length(\"user\") % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS attempts, sha1(answer) AS answer_hash, len(evidence)::BIGINT AS n_evidence, sha1(array_to_string(evidence, '|')) AS evidence_hash, sha1({_JUDGED}) AS judge_hash, page_start, page_end FROM ge",
    "judge_scores": f"""WITH {CURATED}, jx AS (SELECT example_ord, '0.' || (50 + example_ord % 50) AS x, CASE WHEN example_ord % 7 = 2 THEN '"' ELSE '' END AS qu FROM ei),
jb AS (SELECT example_ord, '{{"relevance": 0.5, "groundedness": ' || qu || x || qu || ', "format": 1, "difficulty": 0.25, "overall": ' || x || ', "rationale": "ok"}}' AS body FROM jx),
jr AS (SELECT example_ord, CASE example_ord % 7 WHEN 0 THEN 'no JSON' WHEN 1 THEN replace(body, '"overall"', '"total"') ELSE body END AS raw FROM jb),
jp AS (SELECT example_ord, CASE WHEN json_valid(raw) THEN raw ELSE '{{}}' END AS j FROM jr), jn AS (SELECT example_ord, {_NUMBERS}, json_extract_string(j, '$.rationale') AS rationale FROM jp)
SELECT example_ord, {", ".join(f"CASE WHEN {_FINE} THEN {s} ELSE 0.0 END::DOUBLE AS {s}" for s in G.SCORES)}, CASE WHEN {_FINE} THEN rationale ELSE '{G.NO_SCORE}' END AS rationale FROM jn""",
    "score_reuse": f"WITH {CURATED}, lw AS (SELECT example_id, max(example_ord) AS seq FROM ei WHERE doc_id % 2 = 0 GROUP BY 1), lv AS (SELECT lw.example_id, overall, groundedness FROM lw JOIN ei ON ei.example_ord = lw.seq) SELECT ei.example_ord, lv.overall, lv.groundedness FROM ei LEFT JOIN lv ON ei.example_id = lv.example_id",
    "dataset_mode": f"WITH {MODE} SELECT * FROM mo",
    "export_guard": f"WITH {CURATED}, {_MODE}, ct AS (SELECT count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'eval') AS ev FROM cu WHERE reason IS NULL) SELECT CASE WHEN tr = 0 THEN {q(R.NO_TRAIN)} WHEN mode <> 'single_document' AND (NOT clean_eval OR ev = 0) THEN {q(R.NO_EVAL)} END AS error FROM ct, mo",
    "review_fill": f"WITH {CURATED} SELECT example_ord, example_id, kind AS question_type, coalesce(overall, 0.0)::DOUBLE AS quality_score, split FROM cu WHERE reason IS NULL ORDER BY split <> 'train', cu.question_type, coalesce(overall, 0), example_id, example_ord LIMIT 200",
    "report_lines": f"""WITH {CURATED}, {_MODE}, {CHUNKS}, ps AS (SELECT split, count(*) AS n, count(*) FILTER (reason IS NULL) AS ok FROM cu GROUP BY split)
SELECT 0 AS part, '0' AS ord, '- Modo: ' || label AS line FROM mo UNION ALL SELECT 0, '1', '- Documentos: ' || count(*) FROM documents UNION ALL SELECT 0, '2', '- Chunks: ' || count(*) FROM ch
UNION ALL SELECT 0, '3', '- Eval limpio por doc_id: ' || CASE WHEN clean_eval THEN 'si' ELSE 'no' END FROM mo UNION ALL SELECT 0, '4', '- Aptitud: ' || aptitude FROM mo UNION ALL SELECT 1, split, '- ' || split || ': ' || n FROM ps
UNION ALL SELECT 2, split, '- ' || split || ': accepted=' || ok || ' rejected=' || (n - ok) || ' total=' || n FROM ps UNION ALL SELECT 2, split || '/' || reason, '  - ' || reason || ': ' || count(*) FROM cu WHERE reason IS NOT NULL GROUP BY split, reason""",
    "editor_patch": f"WITH {CURATED}, ids AS (SELECT DISTINCT example_id FROM cu WHERE doc_id % 9 = 0) SELECT example_ord, example_id, sha1(CASE WHEN example_id IN (FROM ids) THEN 'edited' ELSE question END) AS question_hash, reason FROM cu",
    "editor_delete": f"WITH {CURATED}, ids AS (SELECT example_id, bool_or(reason IS NULL) AS ok FROM cu WHERE doc_id % 4 = 1 GROUP BY 1) SELECT example_ord, reason FROM cu LEFT JOIN ids USING (example_id) WHERE ok IS NULL OR ok <> (reason IS NULL)",
    "call_errors": "SELECT CASE WHEN s IN (400, 401, 403) THEN 'permanent' WHEN s IS NULL OR s >= 300 THEN 'retryable' WHEN event_id % 2 = 1 OR NOT json_valid(props) THEN 'malformed' ELSE 'ok' END AS error_class, count(*) AS n FROM (SELECT *, CASE WHEN event_id % 9 <> 8 THEN [200, 200, 400, 401, 403, 408, 429, 503][(event_id % 9 + 1)::INT] END AS s FROM events) GROUP BY 1",
    "phase_plan": f"WITH rn AS ({_RUN}), ph AS (SELECT unnest({list(J.PHASES)!r}) AS phase, unnest(range(0, 8)) AS ord) SELECT run_id, phase, ord, CASE WHEN start IS NOT NULL THEN ord >= start ELSE NOT (resume AND list_contains(completed, phase)) END AS runs FROM rn, ph",
    "text_measures": f"""WITH tm AS (SELECT *, n_chars % 3000 AS wd, doc_id % 2000 AS ht, list_transform({w("lower(substr(" + strip("text") + ", 1, 4000))")}, lambda x: regexp_replace(x, '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g')) AS ws FROM documents), th AS (SELECT *, [{_HITS}] AS hits FROM tm)
SELECT doc_id, CASE WHEN wd > 0 AND ht > 0 THEN 85 + 170 * ceil(wd / 512) * ceil(ht / 512) ELSE 0 END::BIGINT AS image_tokens, CASE lang {" ".join(f"WHEN '{k}' THEN '{x}'" for k, x in T.LANGUAGES.items())} ELSE lang END AS language,
  CASE WHEN length(text) > 40 THEN regexp_replace(substr(text, 1, 39), '[ \\t\\r\\n]+$', '') || '…' ELSE text END AS shown, len({SETS})::BIGINT AS n_distinct,
  CASE WHEN length({strip("text")}) >= 40 AND list_max(hits) > 0 THEN {_LANGS!r}[list_position(hits, list_max(hits))] ELSE 'en' END AS detected FROM th""",
    "batched_plan": f"""WITH RECURSIVE {BATCHES}, {SCORED[len(CHUNKS) + 1:]}, sb AS (SELECT sx.* EXCLUDE (batch), split || '-' || batch_no AS batch FROM sx JOIN bf USING (chunk_id)), bn AS (SELECT batch, count(*) AS n FROM sb GROUP BY batch), {sql.quota('SELECT DISTINCT n AS total FROM bn')},
lo AS (UNPIVOT sb ON extractive, inferential, unanswerable, multi_chunk, format_specific INTO NAME kind VALUE score), rk AS (SELECT batch, kind, chunk_id, row_number() OVER (PARTITION BY batch, kind ORDER BY score DESC, tokens DESC, doc_id, chunk_ord) - 1 AS rank FROM lo),
pk AS (SELECT batch, kind, n, unnest(range(0, quota)) AS pick FROM bn JOIN qu ON total = n) SELECT batch, kind, pick, chunk_id FROM pk JOIN rk USING (batch, kind) WHERE rank = pick % n""",
    "kind_cycle": "SELECT i AS \"index\", CASE WHEN i % 100 < 35 THEN 'extractive' WHEN i % 100 < 60 THEN 'inferential' WHEN i % 100 < 80 THEN 'unanswerable' WHEN i % 100 < 95 THEN 'multi_chunk' ELSE 'format_specific' END AS kind FROM (SELECT event_id AS i FROM events)",
    "selected_chunks": f"WITH {MANIFEST}, {CHUNKS} SELECT chunk_id FROM ch JOIN ma USING (doc_id) WHERE split = 'train' AND doc_id % 3 <> 0 AND chunk_ord % 2 = 0",
    "ocr_pages": f"""WITH {PAGED}, oc AS (SELECT doc_id, page_no, page_text AS t, (doc_id + page_no) % 2 = 0 AS scanned FROM pg WHERE page_text IS NOT NULL), ow AS (SELECT *, {sq("CASE WHEN scanned THEN substr(t, 1, 30) ELSE t END")} AS own, CASE WHEN scanned THEN substr(t, 1, 30) ELSE t END AS raw FROM oc),
ou AS (SELECT *, scanned AND length(own) < 80 AND length(t) > length(own) AS used FROM ow), ov AS (SELECT *, CASE WHEN used THEN t ELSE own END AS page_text, page_no % 3 = 0 OR {any_of('raw', T.FORMULA_MARKERS)} AS visual FROM ou)
SELECT doc_id, page_no, sha1(page_text) AS text_hash, length(page_text)::BIGINT AS text_chars, used AS ocr_used, visual, visual OR used OR length(page_text) < 80 AS requires_multimodal FROM ov""",
    "image_parts": f"""WITH {PAGED}, im AS (SELECT doc_id, list('pages/' || doc_id || '/page-' || lpad(page_no::VARCHAR, greatest(4, length(page_no::VARCHAR))::INT, '0') || '.png' ORDER BY page_no) FILTER ({any_of('page_text', T.FORMULA_MARKERS)} OR length(page_text) < 80) AS l FROM pg GROUP BY doc_id)
SELECT doc_id, coalesce(array_to_string((l[1:20])[1:12], ','), '') AS images FROM im""",
    "judged_examples": f"""WITH {CURATED}, lw AS (SELECT example_id, arg_max(coalesce(overall, 0.0), example_ord) AS score FROM ei WHERE doc_id % 2 = 0 GROUP BY 1),
jq AS (SELECT example_id, arg_min(answer, example_ord) AS a, arg_min(has_evidence, example_ord) AS h FROM ei WHERE example_id NOT IN (SELECT example_id FROM lw) GROUP BY 1),
js AS (SELECT example_id, regexp_extract_all(a, '[^ \\t\\r\\n]+') AS ws, CASE WHEN h THEN '- ' || a ELSE '- no evidence provided' END || {NL} || {NL} || {q(G.JUDGE_TASK)} AS e FROM jq),
jr AS (SELECT example_id, CASE WHEN len(ws) = 0 THEN 0.0 ELSE round_even(len(list_filter(ws, lambda x: contains(e, x))) / len(ws), 3) END AS score FROM js)
SELECT example_ord, round(coalesce(lw.score, jr.score), 6)::DOUBLE AS overall, CASE WHEN lw.score IS NULL THEN 'words in the evidence' ELSE 'earlier' END AS rationale FROM ei LEFT JOIN lw USING (example_id) LEFT JOIN jr USING (example_id)""",
    "examples_of_jobs": f"WITH {CURATED}, jl AS (SELECT DISTINCT job_id FROM ei ORDER BY substr(job_id, 5)::BIGINT DESC LIMIT 3), jx AS (SELECT example_ord, example_id, job_id, count(*) OVER () AS total FROM cu WHERE reason IS NULL AND job_id IN (FROM jl)) SELECT * FROM jx ORDER BY example_ord LIMIT 40 OFFSET 5",
    "examples_sorted": f"WITH {CURATED} SELECT example_ord, coalesce(overall, 0.0)::DOUBLE AS overall FROM cu ORDER BY coalesce(cu.overall, 0) DESC, example_ord LIMIT 50",
    "selected_rows": f"WITH {CURATED}, sl AS (SELECT DISTINCT job_id, example_id, split FROM cu WHERE doc_id % 6 = 0) SELECT job_id, split, example_id, source_doc, sha1(question) AS question, sha1(answer) AS answer, has_evidence::BIGINT AS evidence, question_type, CASE WHEN doc_id % 2 = 0 THEN 'medium' ELSE 'hard' END AS difficulty, is_answerable, overall, reason IS NULL AS accepted, reason FROM cu SEMI JOIN sl USING (job_id, example_id, split)",
    "job_metrics": f"""WITH {CURATED}, jr AS (SELECT *, CASE WHEN overall IS NOT NULL THEN 50 + doc_id * 7 % 51 END AS rel FROM cu), jm AS (SELECT job_id, split, question_type, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected FROM jr GROUP BY ALL),
jv AS (SELECT job_id, split, question_type, name, v, count(*) AS n FROM (SELECT job_id, split, question_type, unnest(['relevance', 'groundedness', 'overall']) AS name, unnest([rel, round(groundedness * 100)::BIGINT, round(overall * 100)::BIGINT]) AS v FROM jr WHERE reason IS NULL) WHERE v IS NOT NULL GROUP BY ALL),
jg AS (SELECT job_id, split, question_type, name, string_agg(v || 'x' || n, ',' ORDER BY v) AS t FROM jv GROUP BY ALL),
jp AS (SELECT job_id, split, question_type, max(t) FILTER (name = 'relevance') AS relevance, max(t) FILTER (name = 'groundedness') AS groundedness, max(t) FILTER (name = 'overall') AS overall FROM jg GROUP BY ALL)
SELECT jm.*, coalesce(relevance, '') AS relevance, coalesce(groundedness, '') AS groundedness, coalesce(overall, '') AS overall FROM jm LEFT JOIN jp USING (job_id, split, question_type)""",
    "job_stats": f"WITH {CURATED} SELECT job_id, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected FROM cu GROUP BY ALL",
    "curation_totals": f"WITH {CURATED}, rc AS (SELECT split, reason, count(*) AS n FROM cu GROUP BY ALL) SELECT split, sum(n)::BIGINT AS total_input, coalesce(sum(n) FILTER (reason IS NULL), 0)::BIGINT AS accepted, coalesce(sum(n) FILTER (reason IS NOT NULL), 0)::BIGINT AS rejected, coalesce(string_agg(reason || '=' || n, ',' ORDER BY reason || '=' || n) FILTER (reason IS NOT NULL), '') AS rejected_by_reason FROM rc GROUP BY split",
    "editor_find": f"WITH {CURATED} SELECT example_id, split, CASE WHEN bool_or(reason IS NULL) THEN 'accepted' ELSE 'rejected' END AS bucket FROM cu WHERE example_id IN (SELECT example_id FROM cu WHERE doc_id % 5 = 0) GROUP BY ALL UNION ALL SELECT 'nowhere', NULL, NULL",
    "editor_bulk": f"WITH {CURATED}, ids AS (SELECT example_id, max(example_ord) FILTER (reason IS NULL) AS last FROM cu WHERE example_id IN (SELECT example_id FROM cu WHERE doc_id % 10 = 3) GROUP BY 1) SELECT example_ord, CASE WHEN reason IS NULL AND example_ord = last THEN 'not wanted' ELSE reason END AS reason FROM cu LEFT JOIN ids USING (example_id) WHERE last IS NULL OR reason IS NOT NULL OR example_ord = last",
    "source_mode": f"SELECT count(*) > 0 AS ok, count(*) AS pdf_count, CASE WHEN count(*) = 1 THEN 'single_document' WHEN count(*) > 1 THEN 'multi_document' END AS mode, CASE WHEN count(*) = 1 THEN {q(R.MODES['single_document'][0])} WHEN count(*) > 1 THEN {q(R.MODES['multi_document'][0])} END AS label, CASE WHEN count(*) = 1 THEN {q(R.MODES['single_document'][1])} WHEN count(*) > 1 THEN {q(R.MODES['multi_document'][1])} ELSE {q(R.NO_SOURCES)} END AS note FROM documents",
    "link_names": """WITH RECURSIVE nf AS (SELECT doc_id AS ord, doc_id % 50 AS family, 'report' || doc_id % 50 || CASE WHEN doc_id % 3 = 0 THEN '-' || (doc_id % 4 + 1) ELSE '' END AS stem FROM documents WHERE doc_id IS NOT NULL),
nk AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY ord) AS k FROM nf),
ns AS (SELECT family, k, ord, stem AS name, [stem] AS used FROM nk WHERE k = 1 UNION ALL
  SELECT family, k, ord, name, list_append(used, name) FROM (SELECT nk.family, nk.k, nk.ord, used, CASE WHEN NOT list_contains(used, stem) THEN stem ELSE stem || '-' || list_min(list_filter(range(1, len(used) + 2), lambda i: NOT list_contains(used, stem || '-' || i))) END AS name FROM ns JOIN nk ON nk.family = ns.family AND nk.k = ns.k + 1))
SELECT ord, name || '.pdf' AS name FROM ns""",
    "job_list": f"WITH {EVENTS} SELECT job_id, min(event_id) AS first_event, arg_max(status, event_id) AS status FROM ev GROUP BY job_id ORDER BY first_event DESC LIMIT 20",
    "job_stats_kept": f"WITH {EVENTS} SELECT job_id, (max(event_id) FILTER (event_id % 3 = 0))::VARCHAR AS stats FROM ev GROUP BY job_id",
    "job_progress": """WITH jb AS (SELECT i // 64 AS job_id, CASE WHEN i % 2 = 0 THEN 'train' ELSE 'eval' END AS split, i % 64 // 2 AS batch, pages, (i % 5) * 1.5::DOUBLE AS seconds FROM (SELECT conv_id AS i, count(*) AS pages FROM conversations GROUP BY conv_id)),
jc AS (SELECT job_id, split, batch, count(*) OVER (PARTITION BY job_id, split) AS total, count(*) OVER o AS done, sum(pages) OVER o AS pages, sum(seconds) OVER o AS s FROM jb WINDOW o AS (PARTITION BY job_id, split ORDER BY batch ROWS UNBOUNDED PRECEDING))
SELECT job_id, split, batch, total AS total_batches, pages::BIGINT AS pages_processed, round_even(s / done * (total - done), 2)::DOUBLE AS eta_seconds, round(CASE split WHEN 'train' THEN 0.32 + (0.62 - 0.32) * batch / total ELSE 0.74 + (0.86 - 0.74) * batch / total END, 6)::DOUBLE AS percent FROM jc""",
    "structured_calls": """WITH RECURSIVE cr AS (SELECT 'call-' || event_id % 97 AS name, row_number() OVER (PARTITION BY event_id % 97 ORDER BY event_id) AS k, ['retryable', 'ok', 'malformed', 'retryable', 'permanent', 'retryable', 'malformed'][((event_id * event_id + event_id // 97) % 7 + 1)::INT] AS c, event_id % 3 = 0 AS f, CASE WHEN event_id % 11 = 0 THEN 2.5::DOUBLE END AS ra FROM events),
cs AS (SELECT name, 0::BIGINT AS k, 'open' AS outcome, 0::BIGINT AS calls, 0::DOUBLE AS waited, TRUE AS strict FROM cr WHERE k = 1 UNION ALL
  SELECT name, k, CASE WHEN c = 'ok' THEN 'ok' WHEN fmt AND calls < 6 THEN 'open' WHEN again AND calls < 6 THEN 'open' WHEN again THEN 'exhausted' ELSE 'permanent' END, calls, CASE WHEN again AND calls < 6 THEN waited + coalesce(ra, least(0.25 * pow(2, calls - 1), 30)) ELSE waited END, strict AND NOT fmt
  FROM (SELECT cr.name, cr.k, c, ra, cs.calls + 1 AS calls, waited, strict, c IN ('retryable', 'malformed') AS again, c = 'permanent' AND strict AND f AS fmt FROM cs JOIN cr ON cr.name = cs.name AND cr.k = cs.k + 1 WHERE outcome = 'open' AND cs.calls < 6))
SELECT name, arg_max(outcome, k) AS outcome, arg_max(calls, k) AS calls, arg_max(waited, k) AS waited_s, arg_max(strict, k) AS strict FROM cs GROUP BY name""",
    "breaker_states": """WITH RECURSIVE bc AS (SELECT 'job-' || user_id % 20 AS name, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS k, event_id AS seq, floor(epoch(ts))::DOUBLE AS sec, (event_id * 7 + event_id // 1300) % 5 < 2 AS failed FROM events),
bs AS (SELECT name, 0::BIGINT AS k, 0::BIGINT AS seq, 'closed' AS state, []::BOOLEAN[] AS recent, 0::DOUBLE AS opened, 0 AS good, FALSE AS refused FROM bc WHERE k = 1 UNION ALL
  SELECT name, k, seq, CASE WHEN trip THEN 'open' WHEN shut THEN 'closed' ELSE s1 END, CASE WHEN shut AND NOT trip THEN [] ELSE r1 END, CASE WHEN trip THEN sec ELSE opened END, g1, refuse FROM (
    SELECT *, NOT refuse AND failed AND (s1 = 'half_open' OR (len(r1) >= 5 AND len(list_filter(r1, lambda x: x)) / len(r1) >= 0.5)) AS trip, NOT refuse AND NOT failed AND s1 = 'half_open' AND g1 >= 2 AS shut FROM (
      SELECT *, CASE WHEN refuse THEN recent ELSE list_append(recent, failed)[-20:] END AS r1, CASE WHEN s1 <> state THEN 0 ELSE good END + (NOT refuse AND NOT failed)::INT AS g1 FROM (
        SELECT *, CASE WHEN state = 'open' AND NOT refuse THEN 'half_open' ELSE state END AS s1 FROM (
          SELECT bc.name, bc.k, bc.seq, sec, failed, state, recent, opened, good, state = 'open' AND sec - opened < 30 AS refuse FROM bs JOIN bc ON bc.name = bs.name AND bc.k = bs.k + 1)))))
SELECT name, seq, state, refused FROM bs WHERE k > 0""",
    "shown_values": """WITH sv AS (SELECT doc_id, i AS n, (i * i / 20.0)::DOUBLE AS s FROM (SELECT doc_id, n_chars AS i FROM documents WHERE n_chars IS NOT NULL)), st AS (SELECT *, floor(s + 0.5)::BIGINT AS t, floor(n / 3000.0 * 100 + 0.5)::BIGINT AS pc FROM sv), sm AS (SELECT *, floor(t / 60 + 0.5)::BIGINT AS mi FROM st), sh AS (SELECT *, floor(mi / 60 + 0.5)::BIGINT AS ho FROM sm)
SELECT doc_id, n, CASE WHEN s <= 0 THEN '—' WHEN t >= 3600 THEN (t // 3600) || 'h ' || (t % 3600 // 60) || 'm' WHEN t >= 60 THEN (t // 60) || 'm ' || (t % 60) || 's' ELSE t || 's' END AS eta, pc || '%' AS percent,
  CASE WHEN t < 60 THEN 'hace instantes' WHEN mi < 60 THEN 'hace ' || mi || ' min' WHEN ho < 24 THEN 'hace ' || ho || ' h' ELSE 'hace ' || floor(ho / 24 + 0.5)::BIGINT || ' d' END AS ago FROM sh""",
    "examples_deep_page": f"WITH {CURATED} SELECT example_ord, example_id, place FROM (SELECT *, row_number() OVER (ORDER BY example_ord) - 1 AS place FROM cu WHERE reason IS NULL) WHERE place >= 10 AND place < 50",
    "trigram_search": sql.SQL["examples_search"],
    "running_lines": f"WITH {_EDGES} SELECT source, edge, line, n, pages FROM ru WHERE n >= greatest(3, 0.02::DOUBLE * pages)",
    "pages_without_running_lines": rf"""WITH {_EDGES}, rl AS (SELECT source, edge, line FROM ru WHERE n >= greatest(3, 0.02::DOUBLE * pages)),
gone AS (SELECT DISTINCT e.doc_id, e.line_no FROM ed e JOIN rl ON rl.source IS NOT DISTINCT FROM e.source AND rl.edge = e.edge AND rl.line = e.line),
kept AS (SELECT rn.doc_id, string_agg(CASE WHEN gone.doc_id IS NULL THEN raw ELSE '' END, chr(10) ORDER BY rn.line_no) AS text FROM rn LEFT JOIN gone ON gone.doc_id = rn.doc_id AND gone.line_no = rn.line_no GROUP BY rn.doc_id)
SELECT doc_id, sha1(kept.text) AS text_hash FROM kept JOIN documents USING (doc_id) WHERE kept.text <> documents.text""",
}

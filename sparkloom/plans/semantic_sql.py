"""SQL (DuckDB's dialect) of the queries on headings, formulas and chunks that follow headings."""

from __future__ import annotations

from sparkloom.functions import headings as H
from sparkloom.functions import maths as M
from sparkloom.operators import semantic as S
from sparkloom.functions import text as T
from sparkloom.plans.base_sql import CASED, TITLE, UPPER, any_of, sq, strip, w
from sparkloom.plans.sql import PAGED

TARGET, OVERLAP = 256, 32


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


PAGE_IDS = "SELECT {'d': doc_id, 'p': page_no} AS id, page_text AS t FROM pg WHERE page_text IS NOT NULL"

_FIRST = r"regexp_extract(h, '^\S+')"
_NUMBERED = f"""CASE WHEN contains(h, 'Capítulo') OR contains(h, 'Chapter') OR regexp_matches(h, '^[IVX]') THEN 1
  WHEN regexp_matches(h, '^\\d+\\s*[.:-]') THEN least(2 + length({_FIRST}) - length(replace({_FIRST}, '.', '')), 3) ELSE 2 END"""
_CAPITALS = f"({UPPER} AND length(h) BETWEEN {H.UPPER_LINE[0]} AND {H.UPPER_LINE[1]})"
_PLAIN = f"""(length(h) < {H.SHORT_LINE} AND NOT regexp_matches(h, '[.,;:]$') AND len({w('h')}) BETWEEN 2 AND {H.SHORT_WORDS} AND regexp_matches(h, '^\\p{{Lu}}')
  AND NOT list_has_any(list_transform(({w('h')})[1:3], lambda x: lower(x)), [{', '.join(map(q, H.FUNCTION_WORDS))}]))"""
_LEVEL = f"CASE WHEN h = '' THEN 0 WHEN regexp_matches(h, {q('(?i)' + H.ANY_NUMBERED)}) THEN {_NUMBERED} WHEN h LIKE '#%' THEN least(length(regexp_extract(h, '^#+')), 3) WHEN {_CAPITALS} OR {_PLAIN} THEN 2 ELSE 0 END"
_TITLED = f"array_to_string(list_transform(regexp_extract_all(h, '[{CASED}]+|[^{CASED}]+'), lambda r: upper(r[1]) || lower(r[2:])), '')"
_SAID = " ".join(f"WHEN regexp_matches(h, {q('(?i)' + p)}) THEN {strip(f'regexp_extract(h, {q(chr(40) + chr(63) + chr(105) + chr(41) + p)}, 1)')}" for p in H.NUMBERED)
_NO_HASH = "regexp_replace(h, '^#+', '')"
_TITLE = f"CASE {_SAID} WHEN h LIKE '#%' THEN {strip(_NO_HASH)} WHEN {_CAPITALS} THEN {_TITLED} ELSE h END"

LINES = f"""
ln AS (SELECT doc_id, source, len(string_split(text, chr(10))) AS n, {strip('unnest(string_split(text, chr(10)))')} AS h, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
lv AS (SELECT *, pos // 5 + 1 AS page, {_LEVEL} AS level FROM ln)"""
_HEADING = f"(h <> '' AND len({w('h')}) <= 8 AND ({TITLE} OR {UPPER} OR h LIKE '#%'))"
_CLEAN = sq(r"regexp_replace(string_agg(h, chr(10) ORDER BY pos) FILTER (NOT head AND h <> ''), '([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)', '\1\2', 'g')")
SECTIONS = f"""
ln AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, {strip('unnest(string_split(text, chr(10)))')} AS h, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
hd AS (SELECT *, {_HEADING} AS head, count(*) FILTER ({_HEADING}) OVER (PARTITION BY doc_id ORDER BY pos) AS section_ord FROM ln),
sg AS (SELECT doc_id, section_ord, any_value(h) FILTER (head) AS h, min(pos) AS a, any_value(n) AS n, {_CLEAN} AS text FROM hd GROUP BY doc_id, section_ord),
se AS (SELECT *, CASE WHEN section_ord = 0 THEN '{S.WHOLE}' ELSE {strip("regexp_replace(h, '^[# ]+', '')")} END AS heading, a // 5 + 1 AS page_start, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY section_ord), n - 1) // 5 + 1 AS page_end FROM sg)"""
TREE = LINES + f""",
hl AS (SELECT doc_id, pos, level, lag(level) OVER d AS before, row_number() OVER d AS i FROM lv WHERE level > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
nn AS (SELECT doc_id, pos, 1 AS level, TRUE AS implied, FALSE AS own, 0 AS sub FROM hl WHERE i = 1 AND level > 1
  UNION ALL SELECT doc_id, pos, 2, TRUE, TRUE, 1 FROM hl WHERE level = 3 AND (i = 1 OR before = 1) UNION ALL SELECT doc_id, pos, level, FALSE, level < 3, 2 FROM hl
  UNION ALL SELECT doc_id, -1, 0, FALSE, TRUE, 2 FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM hl)),
oo AS (SELECT doc_id, pos AS own_pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS stop FROM nn WHERE own),
ot AS (SELECT doc_id, own_pos AS pos, {sq("string_agg(h, ' ' ORDER BY lv.pos)")} AS text FROM oo JOIN lv USING (doc_id) WHERE level = 0 AND lv.pos > own_pos AND (stop IS NULL OR lv.pos < stop) GROUP BY 1, 2),
nm AS (SELECT doc_id, any_value(source) AS source, any_value(n) AS n FROM ln GROUP BY 1),
nx AS (SELECT nn.*, (SELECT min(own_pos) FROM oo WHERE oo.doc_id = nn.doc_id AND own_pos > nn.pos) AS stop FROM nn),
ny AS (SELECT nx.doc_id, nm.source, nx.pos, nx.level, sub, greatest(nx.pos, 0) // 5 + 1 AS page_start, coalesce(stop // 5, (nm.n - 1) // 5 + 1) AS ended, implied,
  CASE WHEN nx.level = 0 THEN '{S.WHOLE}' WHEN implied AND nx.level = 1 THEN '{S.IMPLIED_CHAPTER}' WHEN implied THEN '{S.IMPLIED_SECTION}' ELSE {_TITLE} END AS heading, coalesce(CASE WHEN own THEN text END, '') AS text
  FROM nx JOIN nm USING (doc_id) LEFT JOIN lv USING (doc_id, pos) LEFT JOIN ot ON ot.doc_id = nx.doc_id AND ot.pos = nx.pos),
nz AS (SELECT *, CASE WHEN level = 3 THEN page_start WHEN ended >= page_start THEN ended WHEN implied THEN 1 ELSE page_start END AS reach,
  count(*) FILTER (level < 2) OVER o AS cid, count(*) FILTER (level < 3) OVER o AS sid, row_number() OVER o - 1 AS node_ord FROM ny WINDOW o AS (PARTITION BY doc_id ORDER BY pos, sub)),
tr AS (SELECT doc_id, source, node_ord, level, heading, page_start, text, len({w('text')}) AS tokens, cid,
  CASE WHEN level = 2 THEN coalesce(max(page_start) FILTER (level = 3) OVER (PARTITION BY doc_id, sid), reach) WHEN level < 2 THEN coalesce(max(reach) FILTER (level = 2) OVER (PARTITION BY doc_id, cid), reach) ELSE reach END AS page_end FROM nz)"""
TREE_CHAPTERS = TREE + """,
tc AS (SELECT doc_id, any_value(source) AS source, cid - 1 AS ci, arg_min(heading, node_ord) AS heading, arg_min(page_start, node_ord) AS page_start, arg_min(page_end, node_ord) AS page_end,
  coalesce(string_agg(text, chr(10) || chr(10) ORDER BY node_ord) FILTER (text <> ''), '') AS text, sum(tokens)::BIGINT AS tokens FROM tr GROUP BY doc_id, cid)"""
MERGED = f"""
mf AS (SELECT doc_id, ci, tokens AS mass, 0 AS g FROM ch WHERE ci = 0 UNION ALL
  SELECT ch.doc_id, ch.ci, CASE WHEN mass >= {TARGET // 2} THEN tokens ELSE mass + tokens END, g + (mass >= {TARGET // 2})::INT FROM mf JOIN ch ON ch.doc_id = mf.doc_id AND ch.ci = mf.ci + 1),
ml AS (SELECT doc_id, max(g) AS last, arg_max(mass, ci) AS mass FROM mf GROUP BY doc_id),
mg AS (SELECT mf.doc_id, ci, CASE WHEN g = last AND g > 0 AND ml.mass < {TARGET // 2} THEN g - 1 ELSE g END AS g FROM mf JOIN ml USING (doc_id)),
me AS (SELECT doc_id, any_value(source) AS source, g, string_agg(heading, ' / ' ORDER BY ci) AS heading, arg_min(page_start, ci) AS page_start, arg_max(page_end, ci) AS page_end,
  string_agg(text, chr(10) || chr(10) ORDER BY ci) AS text, sum(tokens)::BIGINT AS tokens FROM ch JOIN mg USING (doc_id, ci) GROUP BY doc_id, g)"""
CHAPTERS = TREE_CHAPTERS + ", ch AS (SELECT * FROM tc)," + MERGED


def _full(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda x: {strip('x')}), lambda x: x <> '')"


PARTS = rf"""
us AS (SELECT *, {_full(r"regexp_split_to_array(text, '\n\s*\n')")} AS ps, {_full(r"string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(30), 'g'), chr(30))")} AS ss, {w('text')} AS ws FROM me),
ul AS (SELECT *, CASE WHEN tokens <= {TARGET} THEN [text] WHEN len(ps) > 1 THEN ps WHEN len(ss) > 1 THEN ss
  ELSE list_transform(range(0, (len(ws) - 1) // {TARGET} + 1), lambda k: array_to_string(ws[k * {TARGET} + 1:(k + 1) * {TARGET}], ' ')) END AS us FROM us),
un AS (SELECT doc_id, source, g, heading, page_start, page_end, len(us) AS n, unnest(us) AS unit, unnest(range(0, len(us))) AS ui FROM ul),
ut AS (SELECT *, len({w('unit')}) AS size FROM un),
pf AS (SELECT doc_id, g, ui, size AS mass, 0 AS p FROM ut WHERE ui = 0 UNION ALL
  SELECT ut.doc_id, ut.g, ut.ui, CASE WHEN mass + size > {TARGET} THEN size ELSE mass + size END, p + (mass + size > {TARGET})::INT FROM pf JOIN ut ON ut.doc_id = pf.doc_id AND ut.g = pf.g AND ut.ui = pf.ui + 1),
pg AS (SELECT doc_id, any_value(source) AS source, g, p, any_value(heading) AS heading, any_value(page_start) AS ps, any_value(page_end) AS pe, any_value(n) AS n, min(ui) AS a,
  string_agg(unit, chr(10) || chr(10) ORDER BY ui) AS text FROM ut JOIN pf USING (doc_id, g, ui) GROUP BY doc_id, g, p),
pp AS (SELECT *, CASE WHEN max(p) OVER s > 0 THEN heading || ' (Parte ' || (p + 1) || ')' ELSE heading END AS title, ps + a * (pe - ps) // n AS page_start,
  coalesce(ps + lead(a) OVER s * (pe - ps) // n, pe) AS page_end, row_number() OVER (PARTITION BY doc_id ORDER BY g, p) - 1 AS chunk_ord,
  array_to_string(({w('text')})[greatest(len({w('text')}) - {OVERLAP} + 1, 1):], ' ') AS tail FROM pg WINDOW s AS (PARTITION BY doc_id, g ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
pb AS (SELECT *, lag(tail) OVER (PARTITION BY doc_id ORDER BY chunk_ord) AS before FROM pp),
sc AS (SELECT doc_id, source, chunk_ord, title AS heading, page_start, page_end, CASE WHEN before <> '' THEN {q(S.CONTINUED.strip())} || chr(10) || before || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text ELSE text END AS text,
  'doc-' || doc_id || '-chunk-' || lpad(chunk_ord::VARCHAR, greatest(4, length(chunk_ord::VARCHAR))::INT, '0') || '-' || substr(sha1('doc-' || doc_id || '-' || chunk_ord || '-' || title), 1, 12) AS chunk_id FROM pb)"""

CHUNKS = CHAPTERS + "," + PARTS

_S = strip("l")
_SYMBOLS = f"length({_S}) - length(translate({_S}, {q(M.SYMBOLS)}, ''))"
_FORMULA = f"""NOT contains(l, {q(M.TOUCHED)}) AND ({_SYMBOLS} >= 2 OR (length({_S}) < {M.LONGEST} AND (({_SYMBOLS} >= 1 AND length(translate({_S}, {q(M.OPERATORS)}, '')) < length({_S})) OR regexp_matches({_S}, {q(M.EQUATION)}))))"""
#: What is hidden in a span: line feeds, carriage returns, dollars and backslashes are those that occur.
_HIDE = "", q(M.HELD[0] + M.HELD[1] + M.HELD[10] + M.HELD[11])


def _held(pattern: str) -> str:
    found = f"list_transform(regexp_extract_all(t, {q(pattern)}), lambda s: {q(M.TOUCHED)} || translate(s, chr(10) || chr(13) || '$' || chr(92), {_HIDE[1]}))"
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array(t, {q(pattern)}), {found}), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '')"


def maths(source: str) -> str:
    """Marked lines of ``source(id, t)``."""
    steps = ",\n".join(f"m{k + 1} AS (SELECT id, {_held(p)} AS t FROM m{k})" for k, p in enumerate(M.LATEX))
    return f"""
m0 AS ({source}), {steps},
ms AS (SELECT id, unnest(regexp_split_to_array(t, '\\r\\n|[\\n\\r]')) AS l, unnest(range(0, len(regexp_split_to_array(t, '\\r\\n|[\\n\\r]')))) AS pos FROM m4),
mm AS (SELECT id, pos, CASE WHEN {_FORMULA} THEN '$$ ' || {_S} || ' $$' ELSE translate(replace(l, {q(M.TOUCHED)}, ''), {_HIDE[1]}, chr(10) || chr(13) || '$' || chr(92)) END AS shown, length(l) - length(replace(l, {q(M.TOUCHED)}, '')) + ({_FORMULA})::INT AS n FROM ms),
mk AS (SELECT id, sum(n)::BIGINT AS expressions, sha1(regexp_replace(string_agg(shown, chr(10) ORDER BY pos), '\\n$', '')) AS text_hash FROM mm GROUP BY id)"""


DOCUMENT_CHUNKS = "WITH RECURSIVE " + PAGED.strip().replace("ln AS", "pl AS").replace("FROM ln", "FROM pl") + "," + SECTIONS.replace("ln AS", "sl AS").replace("FROM ln", "FROM sl") + "," + TREE_CHAPTERS.strip() + f""",
ds AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_ord) - 1 AS ci, count(*) OVER (PARTITION BY doc_id) AS n_sec, heading, page_start, page_end, text, len({w('text')})::BIGINT AS tokens FROM se WHERE text <> '' AND doc_id % 3 <> 0),
ch AS (SELECT doc_id, source, ci, heading, page_start, page_end, ds.text, tokens FROM ds JOIN documents USING (doc_id) WHERE n_sec > 1 UNION ALL SELECT doc_id, source, ci, heading, page_start, page_end, text, tokens FROM tc WHERE doc_id NOT IN (SELECT doc_id FROM ds WHERE n_sec > 1)),
{MERGED}, {PARTS.replace('pg AS', 'pz AS').replace('FROM pg', 'FROM pz')},
fc AS (SELECT doc_id, page_count, words, doc_id IN (SELECT doc_id FROM ds) AS has_sections, n, last FROM np JOIN (SELECT doc_id, sum(len({w('page_text')})) AS words FROM pg GROUP BY 1) USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n, arg_max(page_end, chunk_ord) AS last FROM sc GROUP BY 1) USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL)),
fp AS (SELECT *, CASE WHEN n IS NULL THEN TRUE WHEN has_sections OR page_count <= 1 THEN FALSE WHEN last < page_count THEN TRUE WHEN words > {TARGET} THEN n = 1 OR n < 1 + ceil((words - {TARGET}) / {TARGET - OVERLAP}.0) ELSE FALSE END AS plain FROM fc),
wp AS (SELECT doc_id, page_no, unnest({w('page_text')}) AS w, unnest(range(0, len({w('page_text')}))) AS i FROM pg),
wo AS (SELECT doc_id, w, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, i) - 1 AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM wp),
wk AS (SELECT doc_id, unnest(range(0, CASE WHEN n <= {TARGET} THEN 1 ELSE 1 + ceil((n - {TARGET}) / {TARGET - OVERLAP}.0)::BIGINT END)) AS k FROM (SELECT doc_id, any_value(n) AS n FROM wo GROUP BY 1)),
lg AS (SELECT doc_id, k, min(page_no) AS page_start, max(page_no) AS page_end, string_agg(w, ' ' ORDER BY p) AS text FROM wk JOIN wo USING (doc_id) WHERE p >= k * {TARGET - OVERLAP} AND p < k * {TARGET - OVERLAP} + {TARGET} GROUP BY 1, 2),
b0 AS (SELECT doc_id, chunk_id, chunk_ord, heading, page_start, page_end, text FROM sc JOIN fp USING (doc_id) WHERE NOT plain UNION ALL
  SELECT doc_id, 'doc-' || doc_id || '-chunk-' || lpad((k + 1)::VARCHAR, greatest(4, length((k + 1)::VARCHAR))::INT, '0') || '-' || substr(sha1(text), 1, 10), k, '', page_start, page_end, text FROM lg JOIN fp USING (doc_id) WHERE plain),
lw AS (SELECT chunk_id AS parent, b0.doc_id, chunk_ord, heading, (page_no - page_start) // 4 AS j, min(page_no) AS a, max(page_no) AS b, string_agg(page_text, chr(10) || chr(10) ORDER BY page_no) FILTER (page_text <> '') AS text
  FROM b0 JOIN pg USING (doc_id) WHERE page_end - page_start >= 4 AND page_no BETWEEN page_start AND page_end GROUP BY ALL),
lx AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY j) AS split_part FROM lw WHERE text IS NOT NULL),
b1 AS (SELECT *, NULL::VARCHAR AS split_reason, NULL::VARCHAR AS parent_chunk_id, NULL::BIGINT AS split_part FROM b0 WHERE chunk_id NOT IN (SELECT parent FROM lx) UNION ALL
  SELECT doc_id, parent || '-p' || lpad(a::VARCHAR, greatest(4, length(a::VARCHAR))::INT, '0') || '-' || lpad(b::VARCHAR, greatest(4, length(b::VARCHAR))::INT, '0'), chunk_ord, heading, a, b, text, 'max_pages_per_chunk', parent, split_part FROM lx),
ex AS (SELECT doc_id, page_count, has_sections, CASE WHEN page_count <= 1 THEN 1 ELSE greatest(2, ceil(page_count / 2.0)) END::BIGINT AS expected FROM fp),
sp AS (SELECT doc_id, any_value(page_count) AS page_count, greatest(1, any_value(page_count) // any_value(expected)) AS width FROM b1 JOIN ex USING (doc_id) WHERE NOT has_sections GROUP BY doc_id HAVING count(*) < any_value(expected)),
dg AS (SELECT doc_id, (page_no - 1) // width AS k, min(page_no) AS a, max(page_no) AS b, string_agg(page_text, chr(10) || chr(10) ORDER BY page_no) FILTER (page_text <> '') AS text FROM pg JOIN sp USING (doc_id) GROUP BY ALL),
dh AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS nth FROM dg WHERE text IS NOT NULL),
b2 AS (SELECT * FROM b1 WHERE doc_id NOT IN (SELECT doc_id FROM sp) UNION ALL
  SELECT doc_id, 'doc-' || doc_id || '-chunk-' || lpad(nth::VARCHAR, greatest(4, length(nth::VARCHAR))::INT, '0') || '-' || substr(sha1('doc-' || doc_id || '-min_chunk_density-' || a || '-' || b || '-' || text), 1, 12), nth - 1, '', a, b, text, 'min_chunk_density', NULL::VARCHAR, nth FROM dh),
cv AS (SELECT doc_id, count(DISTINCT p) AS pages_covered FROM (SELECT doc_id, unnest(range(greatest(page_start, 1), greatest(page_start, page_end) + 1)) AS p FROM b2) GROUP BY 1),
ag AS (SELECT doc_id, page_no, {any_of('page_text', T.FORMULA_MARKERS)} OR length(page_text) < 80 AS mm FROM pg),
as_ AS (SELECT chunk_id, coalesce(string_agg('pages/' || b2.doc_id || '/page-' || lpad(page_no::VARCHAR, greatest(4, length(page_no::VARCHAR))::INT, '0') || '.png', ',' ORDER BY page_no) FILTER (mm), '') AS images, coalesce(bool_or(mm), FALSE) AS mm
  FROM b2 LEFT JOIN ag ON ag.doc_id = b2.doc_id AND page_no BETWEEN page_start AND page_end GROUP BY 1),
bo AS (SELECT *, row_number() OVER o - 1 AS ord, coalesce(concat_ws(',', lag(chunk_id) OVER o, lead(chunk_id) OVER o), '') AS neighbors, count(*) OVER (PARTITION BY doc_id) AS chunk_count FROM b2 WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_ord, split_part NULLS FIRST))
SELECT doc_id, chunk_id, ord AS chunk_ord, heading, page_start::BIGINT AS page_start, page_end::BIGINT AS page_end, len({w('text')})::BIGINT AS n_words, neighbors, images AS page_image_paths, mm AS requires_multimodal, FALSE AS uses_ocr, split_reason, parent_chunk_id, split_part,
  split_reason = 'min_chunk_density' AS low_chunk_density_fallback, page_count, pages_covered, round_even(pages_covered / page_count, 4)::DOUBLE AS coverage_ratio, chunk_count, expected AS expected_min_chunks, 'semantic' AS chunking_strategy,
  round_even(pages_covered / page_count, 4) < 0.15 OR chunk_count < expected AS low_coverage, sha1(text) AS text_hash FROM bo JOIN ex USING (doc_id) JOIN cv USING (doc_id) JOIN as_ USING (chunk_id)"""

SQL = {
    "math_marks": f"WITH {maths('SELECT doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL')} SELECT id AS doc_id, expressions, text_hash FROM mk",
    "page_formulas": f"WITH {PAGED}, {maths(PAGE_IDS)} SELECT id.d AS doc_id, id.p AS page_no, expressions, text_hash FROM mk WHERE expressions > 0",
    "document_chunks": DOCUMENT_CHUNKS,
    "heading_levels": f"WITH {LINES} SELECT doc_id, pos AS line_no, level::BIGINT AS level, {_TITLE} AS title FROM lv WHERE level > 0",
    "document_sections": f"WITH {SECTIONS} SELECT doc_id, section_ord, heading, page_start, page_end, sha1(text) AS text_hash FROM se WHERE text <> ''",
    "section_tree": f"WITH {TREE} SELECT doc_id, node_ord, level::BIGINT AS level, heading, page_start, page_end, tokens, sha1(text) AS text_hash FROM tr",
    "merged_sections": f"WITH RECURSIVE {CHAPTERS} SELECT doc_id, g::BIGINT AS section_ord, heading, page_start, page_end, tokens, sha1(text) AS text_hash FROM me",
    "semantic_chunks": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_id, chunk_ord, heading, page_start, page_end, len({w('text')})::BIGINT AS n_words, sha1(text) AS text_hash FROM sc",
}

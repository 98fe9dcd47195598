"""DuckDB SQL with the results of job_queries."""

from __future__ import annotations

from ..operators.replies import ALTERNATIVES, LIMITS, SEGMENT_PROMPT, TEXT_PROMPT
from . import job_queries as Q
from .queries import _IR


def lit(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def pick(values: list, n: str = "doc_id") -> str:
    return f"([{', '.join(map(lit, values))}])[{n} % {len(values)} + 1]"


def issues(text: str) -> str:
    """Whether a text lacks the one expected placeholder, has it twice or has another."""
    return f"(len(regexp_extract_all({text}, '⟦PT0001⟧')) <> 1 OR len(regexp_extract_all({text}, '⟦PT[0-9]{{4}}⟧')) <> 1)"


_STATUS = "CASE WHEN s BETWEEN 200 AND 299 THEN 'ok' WHEN s IN (400, 401, 402, 403, 404, 422) THEN 'permanent' WHEN s IN (408, 429) OR s BETWEEN 500 AND 599 THEN 'retry' ELSE 'permanent' END"
_ALT = " ".join(
    f"WHEN json_type(j, '$.{k}.normal') = 'VARCHAR' THEN [json_extract_string(j, '$.{k}.normal'), json_extract_string(j, '$.{k}.compact')]"
    f" WHEN json_type(j, '$.{k}') = 'VARCHAR' AND json_valid(json_extract_string(j, '$.{k}')) AND json_type(CASE WHEN json_valid(json_extract_string(j, '$.{k}')) THEN json_extract_string(j, '$.{k}') ELSE '0' END, '$.normal') = 'VARCHAR'"
    f" THEN [json_extract_string(json_extract_string(j, '$.{k}'), '$.normal'), json_extract_string(json_extract_string(j, '$.{k}'), '$.compact')]"
    f" WHEN json_type(j, '$.{k}') = 'VARCHAR' THEN [json_extract_string(j, '$.{k}'), NULL]"
    for k in ALTERNATIVES
)
_INT = "CASE WHEN json_type(u, '$.{0}') IN ('UBIGINT', 'BIGINT') THEN json_extract(u, '$.{0}')::BIGINT END"
_REPLIES = f"""
WITH d AS (SELECT doc_id, {pick([s for s, _ in Q.REPLIES])} AS s, {pick([b for _, b in Q.REPLIES])} AS body FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT *, {_STATUS} AS state, CASE WHEN json_valid(body) THEN body END AS p FROM d),
c AS (SELECT *, json_extract(p, '$.usage') AS u, json_extract(p, '$.choices[0]') AS c, CASE WHEN json_type(p, '$.choices[0].message.content') = 'VARCHAR' THEN json_extract_string(p, '$.choices[0].message.content') END AS said FROM p),
t AS (SELECT *, CASE WHEN json_valid(said) THEN said END AS j, {_INT.format('prompt_tokens')} AS i, {_INT.format('completion_tokens')} AS o, {_INT.format('total_tokens')} AS al, {_INT.format('prompt_cache_hit_tokens')} AS h, {_INT.format('prompt_cache_miss_tokens')} AS m FROM c),
f AS (SELECT *, u IS NULL OR coalesce(json_type(u) = 'OBJECT' AND i IS NOT NULL AND o IS NOT NULL AND (json_extract(u, '$.prompt_cache_hit_tokens') IS NULL OR h IS NOT NULL) AND (json_extract(u, '$.prompt_cache_miss_tokens') IS NULL OR coalesce(coalesce(h, 0) + m = i, false))
    AND (json_extract(u, '$.total_tokens') IS NULL OR coalesce(al = i + o, false)) AND coalesce(h, 0) <= i, false) AS fine,
  CASE WHEN json_type(j) <> 'OBJECT' THEN NULL WHEN json_extract(j, '$.normal') IS NOT NULL THEN [CASE WHEN json_type(j, '$.normal') = 'VARCHAR' THEN json_extract_string(j, '$.normal') END, CASE WHEN json_type(j, '$.compact') = 'VARCHAR' THEN json_extract_string(j, '$.compact') END] {_ALT}
    ELSE CASE WHEN len(list_filter(json_keys(j), lambda k: json_type(j, '$.' || k) = 'VARCHAR')) = 1 THEN [json_extract_string(j, '$.' || list_filter(json_keys(j), lambda k: json_type(j, '$.' || k) = 'VARCHAR')[1]), NULL] END END AS f FROM t),
n AS (SELECT *, f[1] AS n, CASE WHEN trim(f[2]) <> '' THEN f[2] END AS k FROM f),
e AS (SELECT *, CASE WHEN state <> 'ok' THEN 'provider_http_error' WHEN coalesce(json_type(p) <> 'OBJECT', true) THEN 'invalid_json_response' WHEN NOT fine THEN 'invalid_usage' WHEN coalesce(json_type(c) <> 'OBJECT', true) THEN 'missing_choices'
  WHEN coalesce(json_extract_string(c, '$.finish_reason'), '') <> 'stop' THEN 'incomplete_response' WHEN coalesce(trim(said), '') = '' THEN 'empty_response' WHEN j IS NULL THEN 'invalid_json_response' WHEN json_type(j) <> 'OBJECT' OR n IS NULL THEN 'invalid_translation_fields'
  WHEN trim(n) = '' THEN 'empty_translation_fields' WHEN {issues('n')} OR coalesce({issues('k')}, false) THEN 'placeholder_validation_error' END AS error_type FROM n)
SELECT doc_id, CASE WHEN state <> 'ok' THEN state WHEN error_type IS NULL THEN 'ok' ELSE 'retry' END AS kind, error_type,
  CASE WHEN state <> 'ok' THEN left(trim(regexp_replace(coalesce(json_extract_string(p, '$.error.message'), CASE WHEN json_type(p, '$.error') = 'VARCHAR' THEN json_extract_string(p, '$.error') END, json_extract_string(p, '$.message'), body), '(?i)(?:sk-[a-z0-9_-]{{6,}}|Bearer\\s+\\S+)', '[REDACTED]', 'g')), 200) END AS detail,
  CASE WHEN error_type IS NULL THEN n END AS normal, CASE WHEN error_type IS NULL THEN k END AS compact, CASE WHEN fine AND u IS NOT NULL THEN i END AS input_tokens, CASE WHEN fine AND u IS NOT NULL THEN coalesce(h, 0) END AS cached_tokens, CASE WHEN fine AND u IS NOT NULL THEN o END AS output_tokens,
  CASE WHEN fine AND u IS NOT NULL THEN i - coalesce(h, 0) END AS uncached_tokens FROM e"""

_TASKS = """e AS (SELECT user_id, user_id::VARCHAR AS id, event_id AS seq, event_type = 'error' AND event_id % 4 = 0 AS deleted, user_id % 2 = 1 AS pdf,
  CASE WHEN user_id % 2 = 0 THEN '文本翻译' WHEN user_id % 3 = 0 THEN 'PAPER  ' || user_id || '.v1' WHEN user_id % 3 = 1 THEN '' ELSE 'A real title' END AS title, user_id % 5 = 0 AS resolved,
  CASE WHEN user_id % 2 = 0 THEN 'completed' WHEN event_type = 'signup' THEN 'queued' WHEN event_type = 'view' THEN 'running' WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN user_id % 2 = 1 THEN '/in/paper ' || user_id || '.v1.pdf' END AS source_path FROM events WHERE user_id IS NOT NULL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS nth FROM e) WHERE nth = 1 AND NOT deleted)"""
_BODIES = "b AS (SELECT doc_id::VARCHAR AS id, min(regexp_replace(text, '[^ -~\\n]', '', 'g')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)"
_SHORT = "CASE WHEN length({0}) > {1} THEN rtrim(left({0}, {1} - 1), ' ') || '…' ELSE {0} END"
_LINES = f"""{_IR}, g AS (SELECT *, CASE WHEN region_ord % 3 = 0 THEN 40 ELSE 12 END AS dy FROM r),
o AS (SELECT doc_id, page_no, region_ord AS line_no, CASE WHEN region_ord % 11 = 0 THEN ' ' ELSE source_text END AS text, 0.7 + (region_ord % 4)::DOUBLE / 10 AS confidence, least(600, x0) AS x0, least(800, y0 + dy) AS y0, least(600, x1) AS x1, least(800, CASE WHEN region_ord % 7 = 0 THEN y0 + dy + 0.25 ELSE y1 + dy END) AS y1 FROM g),
q AS (SELECT *, trim(text) = '' OR x1 - x0 < 0.5 OR y1 - y0 < 0.5 AS rejected FROM o),
n AS (SELECT * FROM q WHERE NOT rejected AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = q.doc_id AND r.page_no = q.page_no
  AND greatest(0, least(q.x1, r.x1) - greatest(q.x0, r.x0)) * greatest(0, least(q.y1, r.y1) - greatest(q.y0, r.y0)) >= 0.5 * greatest(1, (q.x1 - q.x0) * (q.y1 - q.y0))))"""

ORACLE_SQL = {
    "reply_parsing": _REPLIES,
    "model_ids": f"""WITH b AS (SELECT {pick(Q.LISTING)} AS x FROM documents), v AS (SELECT DISTINCT x FROM b WHERE json_valid(x)), m AS (SELECT unnest(json_extract(x, '$.data[*]')) AS m FROM v)
SELECT DISTINCT trim(json_extract_string(m, '$.id')) AS id FROM m WHERE json_type(m, '$.id') = 'VARCHAR' AND trim(json_extract_string(m, '$.id')) <> '' ORDER BY id""",
    "endpoints": """SELECT doc_id, (CASE WHEN doc_id % 2 = 1 THEN CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 2 END WHEN doc_id % 3 <> 0 THEN 1 ELSE 2 END)::INT AS used, 'https://a.example/v1 https://b.example' AS urls FROM documents""",
    "configurations": f"SELECT doc_id, {pick([x in (1, 2, 3, 5, 6, 8) for x in range(len(Q.CONFIGURATIONS))]).replace('True', 'true').replace('False', 'false')} AS holds_secret FROM documents",
    "clean_fields": f"""SELECT doc_id, CASE WHEN doc_id % 700 BETWEEN 100 AND 599 THEN (doc_id % 700)::INT END AS status, CASE WHEN regexp_full_match({pick(['flow-p1-text-2', '', '-x', 'a b', 'p:1.2_3', 'é', 'x' * 129])}, '[a-zA-Z0-9][a-zA-Z0-9_.:-]*') AND length({pick(['flow-p1-text-2', '', '-x', 'a b', 'p:1.2_3', 'é', 'x' * 129])}) <= 128 THEN {pick(['flow-p1-text-2', '', '-x', 'a b', 'p:1.2_3', 'é', 'x' * 129])} END AS segment_id,
  CASE WHEN doc_id % 5 - 1 > 0 THEN (doc_id % 5 - 1)::INT END AS attempts FROM documents""",
    "languages": f"""SELECT doc_id, {pick(['Simplified Chinese', 'English', 'English', 'ko-KR', 'Zh-TW', 'Portuguese', 'Simplified Chinese', 'xx-YY', 'Russian', 'id'])} AS name, {pick(['zh', 'en', 'en', 'ko', 'zh', 'pt', '', 'xx', 'ru', 'id'])} AS base,
  {pick(['zh', 'en', 'en', 'ko', 'zh', 'pt', '', 'xx', 'ru', 'id'])} IN ('en', 'ko', 'pt', 'ru', 'id') AS segmented FROM documents""",
    "chat_messages": f"SELECT conv_id, turn, length(replace(CASE WHEN turn % 2 = 0 THEN {lit(TEXT_PROMPT)} ELSE {lit(SEGMENT_PROMPT)} END, '{{}}', 'German'))::INT AS system_chars, "
    """md5('{"protected_tokens": ["⟦PT0001⟧"], "segment_context": {"section_title": ""}, "source_language": "en", "source_text": ' || to_json(regexp_replace(text, '[^ -~]', ' ', 'g'))::VARCHAR || ', "target_language": "de"}') AS user_md5 FROM conversations WHERE text IS NOT NULL""",
    "safe_messages": f"""SELECT doc_id, {pick(['failed, check the configuration', 'key [REDACTED] is wrong', 'failed, check the configuration', 'failed, check the configuration', 'plain failure', 'long ' + 'x' * 295])} AS said, {pick(['', 'key abc123 is wrong', 'got sk-1', '[REDACTED]', 'plain failure', 'long ' + 'x' * 195])} AS detail,
  (CASE WHEN doc_id % 2 = 0 THEN {len('Mock Chinese is synthetic and must not be evaluated for translation quality.')} ELSE {len('Source text is transmitted to the selected external provider: kimi.')} END + {sum(map(len, LIMITS)) + 2})::INT AS limit_chars FROM documents""",
    "task_list": f"""WITH {_TASKS}, {_BODIES}, s AS (SELECT k.*, trim(regexp_replace(left(b.text, 4096), '\\s+', ' ', 'g')) AS t FROM k LEFT JOIN b USING (id))
SELECT id, CASE WHEN pdf THEN 'pdf' ELSE 'text' END AS kind, title, status, seq AS updated_at, CASE WHEN NOT pdf THEN coalesce(nullif({_SHORT.format('t', 120)}, ''), '文本内容不可用') END AS preview FROM s""",
    "task_details": f"WITH {_TASKS}, {_BODIES} SELECT id, status, length(b.text)::INT AS chars FROM k LEFT JOIN b USING (id) WHERE status NOT IN ('queued', 'running')",
    "task_titles": f"""WITH {_TASKS} SELECT id, CASE WHEN resolved OR user_id % 3 = 2 THEN title WHEN user_id % 4 = 1 THEN 'Found on page ' || id ELSE {pick(['untitled', 'Microsoft Word - x.doc', 'Its own title', 'paper'], 'user_id').replace("'untitled'", "'paper ' || id || '.v1'").replace("'Microsoft Word - x.doc'", "'paper ' || id || '.v1'").replace("'paper']", "'paper ' || id || '.v1']")} END AS title, resolved OR user_id % 3 <> 2 AS title_resolved FROM k WHERE pdf""",
    "retained_paths": f"WITH {_TASKS} SELECT source_path FROM k WHERE pdf UNION SELECT '/in/paper ' || c_custkey || '.v1.pdf' FROM customer",
    "public_reports": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 2 THEN NULL ELSE false END AS passed, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 2 THEN NULL ELSE 0 END::BIGINT AS overflow_count, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 2 THEN NULL ELSE 0 END::BIGINT AS overlap_count, CASE WHEN doc_id % 4 = 0 THEN 6.5 END::DOUBLE AS minimum_font_size FROM documents""",
    "recognised_regions": f"WITH {_LINES} SELECT doc_id, page_no, line_no, 'p' || page_no || '-ocr-' || (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) - 1) AS region_id, x0, y0, x1, y1, round(greatest(6, (y1 - y0) * 0.78), 6) AS font_size, round(confidence, 4) AS content_confidence FROM n",
    "recognition_runs": f"""WITH {_LINES}, a AS (SELECT doc_id, count(DISTINCT page_no) AS candidate_pages, count(*) AS lines, count(*) FILTER (rejected) AS rejected_lines FROM q GROUP BY doc_id), b AS (SELECT doc_id, count(DISTINCT page_no) AS recognized_pages, count(*) AS recognized_lines FROM n GROUP BY doc_id)
SELECT doc_id, candidate_pages, lines, rejected_lines, coalesce(recognized_pages, 0) AS recognized_pages, coalesce(recognized_lines, 0) AS recognized_lines, lines - rejected_lines - coalesce(recognized_lines, 0) AS duplicate_lines FROM a LEFT JOIN b USING (doc_id)""",
    "text_heavy_pages": f"WITH {_LINES} SELECT doc_id, page_no FROM o GROUP BY ALL HAVING count(*) >= 3 AND sum(length(regexp_replace(text, '\\s', '', 'g'))) >= 80 AND avg(confidence) >= 0.8",
    "image_candidates": f"""WITH {_IR}, i AS (SELECT doc_id, page_no, region_ord, x1 + region_ord % 5 * 90 - x0 AS w, y1 + region_ord % 7 * 120 - y0 AS h FROM r WHERE region_ord % 2 = 0)
SELECT doc_id, page_no, region_ord, w * h / 480000 >= 0.6 AS ocr_background FROM i WHERE w / 600 >= 0.25 AND h / 800 >= 0.12 AND w * h / 480000 >= 0.08""",
    "protection_stats": """WITH t AS (SELECT conv_id AS doc_id, turn % 3 AS m, [turn % 5, turn % 2 + 1] AS f, CASE WHEN turn % 3 = 0 THEN []::BIGINT[] ELSE [turn % 3, turn % 3 + 1] END AS e FROM conversations),
i AS (SELECT *, len(list_filter(e, lambda x: NOT list_contains(f, x))) AS mi, len(list_filter(e, lambda x: len(list_filter(f, lambda y: y = x)) > 1)) AS du, len(list_distinct(list_filter(f, lambda x: NOT list_contains(e, x)))) AS un FROM t)
SELECT doc_id, count(*) AS segment_count, count(*) FILTER (m <> 0) AS protected_segment_count, sum(len(e))::BIGINT AS token_count, sum(len(e) - mi)::BIGINT AS restored_token_count, sum(mi)::BIGINT AS missing_token_count, sum(du)::BIGINT AS duplicated_token_count, sum(un)::BIGINT AS unknown_token_count, bool_and(mi + du + un = 0) AS passed FROM i GROUP BY doc_id""",
    "flow_fonts": f"WITH {_IR} SELECT doc_id, 'flow-' || region_ord // 3 AS flow_id, median(font_size)::DOUBLE AS font_size, min_by(type, region_ord) = 'heading' OR avg((flags & 16 <> 0)::INT) >= 0.5 AS bold FROM r GROUP BY doc_id, region_ord // 3",
    "layout_stats": """WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber % 3 AS k, bool_and(l_quantity < 45) AS fit, bool_or(l_returnflag <> 'N') AS normal, min(4 + l_linenumber % 5)::DOUBLE AS size, count(*) AS lines, max(floor(l_quantity))::BIGINT AS rest, max(l_linenumber % 2)::BIGINT AS blocked FROM lineitem GROUP BY ALL)
SELECT doc_id, count(*) AS flow_count, count(*) FILTER (fit) AS fit_flow_count, count(*) FILTER (NOT fit) AS overflow_flow_count, count(*) FILTER (NOT normal) AS compact_flow_count, count(*) FILTER (size < 8) AS reduced_font_flow_count, min(size) AS minimum_font_size, 0.65::DOUBLE AS minimum_font_scale_floor, round(min(size / 8), 4) AS minimum_font_scale,
  count(*) FILTER (size < 6) AS new_sub_6pt_flow_count, sum(lines)::BIGINT AS line_count, sum(rest)::BIGINT AS overflow_characters, sum(blocked)::BIGINT AS blocked_line_slot_count FROM f GROUP BY doc_id""",
    "font_styles": f"""WITH d AS (SELECT doc_id, doc_id % 32 AS fl, doc_id * 65793 % 16777216 AS c, replace(lower(coalesce({pick(Q.FONTS)}, '')), '+', '') AS n FROM documents),
s AS (SELECT *, CASE WHEN regexp_matches(n, 'courier|mono|cmtt') THEN 'courier' WHEN regexp_matches(n, 'helvetica|arial|sans|cmss') THEN 'arial' ELSE 'times' END AS family, fl & 16 <> 0 OR regexp_matches(n, 'bold|cmbx|cmssbx|-bd|black') AS bold, fl & 2 <> 0 OR regexp_matches(n, 'italic|oblique|cmti|cmmi|-it') AS italic FROM d)
SELECT doc_id, family, bold, italic, CASE WHEN NOT bold AND NOT italic THEN CASE family WHEN 'courier' THEN 'cour' WHEN 'arial' THEN 'helv' ELSE 'tiro' END ELSE CASE family WHEN 'courier' THEN 'co' WHEN 'arial' THEN 'he' ELSE 'ti' END || CASE WHEN bold AND italic THEN 'bi' WHEN bold THEN 'bo' ELSE 'it' END END AS builtin,
  round((c >> 16) / 255, 6) AS r, round((c >> 8 & 255) / 255, 6) AS g, round((c & 255) / 255, 6) AS b FROM s""",
    "font_counts": "WITH f AS (SELECT l_orderkey AS doc_id, l_returnflag AS font, count(*) AS n FROM lineitem GROUP BY ALL) SELECT doc_id, sum(n)::BIGINT AS spans, string_agg(font || '=' || n, ',' ORDER BY font) AS fonts FROM f GROUP BY doc_id",
    "paired_pages": f"""WITH {_IR}, p AS (SELECT doc_id, page_no, min_by(source_text, region_ord) AS text FROM r GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS place FROM p), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS place FROM p WHERE page_no > 1)
SELECT doc_id, place::INT AS place, a.page_no, b.page_no AS page_no2, md5(b.text) AS truth_md5 FROM a JOIN b USING (doc_id, place)""",
    "inspection_reports": f"""WITH {_IR}, p AS (SELECT doc_id, page_no, count(*) AS n, count(*) FILTER (region_ord % 2 = 0) AS t FROM r GROUP BY ALL),
x AS (SELECT doc_id, '# PDF inspection report' || chr(10) || chr(10) || '- Pages: ' || count(*) || chr(10) || '- Text flows: ' || sum(n) || chr(10) || '- Merged flows: 0' || chr(10) || '- Cross-column continuations: 1' || chr(10) || '- Cross-page continuations: 2' || chr(10) || '- Dehyphenation decisions: 3' || chr(10) || chr(10)
  || '## Page summary' || chr(10) || chr(10) || '| Page | Regions | Translatable | OCR action |' || chr(10) || '| ---: | ---: | ---: | --- |' || chr(10) || string_agg('| ' || page_no || ' | ' || n || ' | ' || t || ' | keep_native |', chr(10) ORDER BY page_no) || chr(10) AS report FROM p GROUP BY doc_id)
SELECT doc_id, length(report)::INT AS chars, md5(report) AS report_md5 FROM x""",
    "page_windows": """WITH d AS (SELECT doc_id, doc_id % 13 - 1 AS p, doc_id % 5 + 1 AS p2, doc_id % 7 AS n, doc_id % 6 AS q FROM documents),
w AS (SELECT *, CASE WHEN n > 0 THEN range(greatest(1, least(greatest(p, 1), n) - 2), least(n, least(greatest(p, 1), n) + 2) + 1) ELSE [] END AS a, CASE WHEN n > 0 THEN range(greatest(1, least(greatest(p2, 1), n) - 2), least(n, least(greatest(p2, 1), n) + 2) + 1) ELSE [] END AS b FROM d)
SELECT doc_id, array_to_string(a, ',') AS pages, array_to_string(list_filter([1, 9, 4], lambda x: list_contains(a, x) OR list_contains(b, x)), ',') AS kept, array_to_string(list_filter(a || list_filter(b, lambda x: NOT list_contains(a, x)), lambda x: x NOT IN (1, 9, 4)), ',') AS missing,
  array_to_string(list_filter([1, 9, 4], lambda x: NOT (list_contains(a, x) OR list_contains(b, x))), ',') AS dropped, (CASE WHEN list_contains(b, q) THEN q ELSE b[1] END)::INT AS linked FROM w""",
    "paragraph_hits": f"""WITH {_IR}, p AS (SELECT doc_id, page_no, region_ord * 4 + k AS point_id, [60, 200, 330, 599][k + 1] AS x, y0 + 11 + k * 2 AS y FROM r, range(4) AS t(k))
SELECT p.doc_id, p.page_no, point_id::INT AS point_id, min_by('flow-' || region_ord // 2, region_ord) AS flow_id FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.page_no = r.page_no AND x BETWEEN x0 - 3 AND x1 + 3 AND y BETWEEN y0 - 3 AND y1 + 3 GROUP BY ALL""",
    "selections": f"""WITH {_IR}, p AS (SELECT doc_id, page_no, region_ord AS selection_id, [60, 200][k + 1] AS x, y0 + 11 + k * 2 AS y, k FROM r, range(2) AS t(k)),
h AS (SELECT p.doc_id, p.page_no, selection_id, k, min_by('flow-' || region_ord // 2, region_ord) AS f FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.page_no = r.page_no AND x BETWEEN x0 - 3 AND x1 + 3 AND y BETWEEN y0 - 3 AND y1 + 3 GROUP BY ALL)
SELECT doc_id, page_no, selection_id, min(f) AS flow_id FROM h GROUP BY ALL HAVING bool_and(f IS NOT NULL) AND count(DISTINCT f) = 1""",
    "glossary_problems": """WITH t AS (SELECT CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE CASE WHEN doc_id % 2 = 0 THEN 'Term' ELSE 'term' END || doc_id // 2 END AS s, repeat('x', (doc_id % 210)::BIGINT) AS t FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT unnest([{'rule': 'blank', 'n': count(*) FILTER (trim(s) = '') + count(*) FILTER (trim(t) = '')}, {'rule': 'too_long', 'n': count(*) FILTER (length(s) > 200 OR length(t) > 200)}, {'rule': 'duplicate', 'n': count(*) - count(DISTINCT lower(s))}, {'rule': 'too_many', 'n': greatest(count(*) - 500, 0)}]) AS p FROM t)
SELECT p.rule, p.n::BIGINT AS count FROM p WHERE p.n > 0""",
    "base_types": f"""WITH {_IR}, b AS (SELECT doc_id, page_no, region_ord, y0 - 70 + region_ord % 3 * 60 AS y0, y1 - 75 + region_ord % 3 * 60 AS y1, 8 + region_ord % 7 AS s, CASE WHEN region_ord % 4 = 0 THEN ' 12 ' ELSE source_text END AS t FROM r)
SELECT doc_id, page_no, region_ord, CASE WHEN regexp_matches(trim(t), '^[0-9]+$') AND y0 >= 656 THEN 'page_number' WHEN y1 <= 64 THEN 'header' WHEN y0 >= 736 THEN 'footer' WHEN s >= 13.5 AND y0 <= 360 THEN 'title' WHEN s >= 11.5 THEN 'heading' ELSE 'paragraph' END AS type FROM b""",
    "page_texts": f"""WITH {_IR}, t AS (SELECT *, CASE WHEN region_ord % 5 <> 0 THEN region_ord % 17 END AS o, regexp_replace(source_text, '[^ -~]', '', 'g') AS t FROM r)
SELECT doc_id, page_no, md5(trim(regexp_replace(string_agg(t, ' ' ORDER BY o IS NULL, o, y0, x0, region_ord), '\\s+', ' ', 'g'))) AS text_md5 FROM t WHERE t <> '' GROUP BY ALL""",
    "block_styles": """WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '[^ -~\n]', '', 'g'), chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT *, flatten(list_transform(l, lambda x: string_split(x, ' '))) AS w FROM d),
b AS (SELECT *, list_filter(w, lambda x: length(x) = list_max(list_transform(w, lambda y: length(y))))[1] AS b FROM w)
SELECT doc_id, md5(array_to_string(list_filter(list_transform(l, lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS text_md5, len(w)::INT AS spans, 'f' || length(b) % 3 AS font, (length(b) % 5 + 8)::DOUBLE AS size, (length(b) % 2 * 16)::INT AS flags,
  list_max(list_transform(w, lambda x: length(x) % 5 + 8))::DOUBLE AS largest, list_median(list_transform(w, lambda x: length(x) % 5 + 8))::DOUBLE AS body_size FROM b""",
    "visual_lines": f"""WITH {_IR}, c AS (SELECT *, (y0 + y1) / 2 AS m, max(font_size) OVER (PARTITION BY doc_id, page_no) AS f, max(y1) OVER (PARTITION BY doc_id, page_no) AS h FROM r),
s AS (SELECT *, m - lag(m) OVER (PARTITION BY doc_id, page_no ORDER BY m) AS step FROM c WHERE region_ord % 4 <> 0), n AS (SELECT doc_id, page_no, 1 + count(*) FILTER (step > greatest(1, 0.35 * f)) AS n FROM s GROUP BY ALL)
SELECT doc_id, page_no, coalesce(any_value(n.n), greatest(1, round_even(max(h) / max(f), 0)))::INT AS lines FROM c LEFT JOIN n USING (doc_id, page_no) GROUP BY ALL""",
    "request_checks": """WITH d AS (SELECT doc_id, text, doc_id % 3 AS m, doc_id % 4 AS p, (doc_id // 4) % 3 AS u, (doc_id // 3) % 2 = 0 AS k, (doc_id // 7) % 2 = 1 AS blank FROM documents)
SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_text' WHEN length(text) > 20000 THEN 'text_too_long' WHEN m = 1 AND length(text) > 300 THEN 'selection_too_long' WHEN m = 2 OR m IS NULL THEN 'unknown_mode' WHEN p = 3 THEN 'unknown_provider' WHEN p <> 0 AND NOT k THEN 'missing_key'
  WHEN p = 2 AND u = 1 THEN 'missing_address_or_model' WHEN p = 2 AND u = 2 THEN 'bad_address' WHEN blank THEN 'missing_language' END AS problem FROM d""",
    "round_trip_gates": f"""WITH {_IR}, p AS (SELECT doc_id, count(DISTINCT page_no) AS n FROM r GROUP BY doc_id)
SELECT doc_id, n AS source_page_count, CASE WHEN doc_id % 5 = 1 THEN 1 ELSE n END AS output_page_count, NOT ((doc_id % 5 = 1 AND n > 1) OR doc_id % 5 > 1) AS passed,
  CASE doc_id % 5 WHEN 1 THEN CASE WHEN n > 1 THEN 'same_page_count,links_preserved' ELSE '' END WHEN 2 THEN 'text_similarity_at_least_0_98' WHEN 3 THEN 'same_page_dimensions' WHEN 4 THEN 'no_skipped_regions' ELSE '' END AS failed, 0.0::DOUBLE AS mean_changed_fraction FROM p""",
    "rounded_boxes": """WITH b AS (SELECT l_orderkey, l_linenumber NOT IN (3, 4, 5) AS ok, round(l_quantity / 7, 3) AS x FROM lineitem) SELECT l_orderkey, count(*) FILTER (ok) AS boxes, round_even(coalesce(sum(x) FILTER (ok), 0) * 1000, 0)::BIGINT AS x0_sum FROM b GROUP BY l_orderkey""",
    "region_sequence": f"WITH {_IR} SELECT doc_id, page_no, region_ord, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY region_ord % 4 = 1, CASE WHEN region_ord % 4 <> 1 THEN 100 - region_ord END, y0, x0, region_ord))::INT AS position FROM r",
    "page_decisions": f"""WITH {_IR}, p AS (SELECT doc_id, page_no, count(*) AS n, sum(length(regexp_replace(source_text, '\\s', '', 'g'))) AS ch FROM r GROUP BY ALL),
a AS (SELECT *, CASE WHEN page_no % 2 = 1 THEN 'keep_native' WHEN ch >= 40 AND doc_id % 2 <> 0 THEN 'use_ocr' ELSE 'review' END AS action FROM p)
SELECT doc_id, action, sum(n)::BIGINT AS regions FROM a WHERE doc_id NOT IN (SELECT doc_id FROM a WHERE action = 'review') GROUP BY ALL""",
    "cached_translations": "SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM documents c WHERE c.source = 'src0' AND coalesce(c.text, '') = coalesce(d.text, '')) THEN 'from cache' ELSE length(coalesce(text, ''))::VARCHAR END AS normal FROM documents d",
    "unreferenced_files": """WITH f AS (SELECT '/up/' || doc_id % 50 || '/' || doc_id % 7 || '/' || doc_id AS path, '/up/' || doc_id % 50 || '/' || doc_id % 7 AS up FROM documents WHERE doc_id IS NOT NULL) SELECT path FROM f WHERE up NOT IN (SELECT '/up/' || c_custkey % 90 || '/' || c_custkey % 3 FROM customer)""",
}

"""Oracle SQL of queries whose operators fold: reading order, pages, segments, anchors, sections and scans."""

from __future__ import annotations

from vellumspark.plans.extraction import _LINES, _MD
from vellumspark.plans.extraction import ORACLE as _EXTRACTION
from vellumspark.plans.lookups import PLAIN_HTML
from vellumspark.plans.records import _AN, _HT, _PAGES

QUERIES: dict = {}

_AT = "list_filter(range(0, length({t})), lambda i: substr({t}, i + 1, length({n})) = {n})"
_SIDE = "list_max(list_filter(range(0, strlen({0}) + 1), lambda k: strlen({1}) <= strlen({0})))"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

#: Scored occurrences ``y`` of annotations ``an``, numbered from the best.
_ANCHORS = f"""
m AS (SELECT annotation_id, document_id, {_TRIM.format("highlighted_text")} AS needle, prefix, suffix, {_TRIM.format("prefix")} AS p, {_TRIM.format("suffix")} AS s FROM an),
c AS (SELECT m.*, b.block_id, b.sort_order, b.text, unnest({_AT.format(t="b.text", n="needle")}) AS i FROM m JOIN b ON m.document_id = b.document_id AND contains(b.text, needle) WHERE needle <> ''),
w AS (SELECT *, strlen(left(text, i)) AS start, right(left(text, i), {_SIDE.format("prefix", "right(left(text, i), k)")}) AS l, substr(text, i + length(needle) + 1, {_SIDE.format("suffix", "substr(text, i + length(needle) + 1, k)")}) AS r FROM c),
x AS (SELECT *, 0.5::DOUBLE + CASE WHEN p <> '' AND l <> '' AND (contains(l, right(p, 10)) OR contains(p, l)) THEN 0.25 ELSE 0 END + CASE WHEN s <> '' AND r <> '' AND (contains(r, left(s, 10)) OR contains(s, r)) THEN 0.25 ELSE 0 END
  - least(0.15, abs(start - 20) / 20000.0::DOUBLE) AS score FROM w),
y AS (SELECT *, row_number() OVER (PARTITION BY annotation_id ORDER BY score DESC, sort_order, block_id, start) AS n FROM x)
"""

#: Reading order ``ro`` of the pages' tokens: lines of a page, its columns, rows of a column, then positions.
_ORDER = """RECURSIVE """ + _PAGES + """,
k AS (SELECT document_id, page, token_no, "left" AS a, bottom AS b, "right" AS c, top AS d, text, row_number() OVER (PARTITION BY document_id, page ORDER BY bottom DESC, token_no) AS k FROM tokens),
ln AS (SELECT document_id, page, 1::BIGINT AS k, [[a, b, c, d]] AS lines FROM k WHERE k = 1
  UNION ALL SELECT document_id, page, k, CASE WHEN hit IS NULL THEN list_append(lines, [a, b, c, d]) ELSE list_concat(list_append(lines[:hit - 1], [least(lines[hit][1], a), least(lines[hit][2], b), greatest(lines[hit][3], c), greatest(lines[hit][4], d)]), lines[hit + 1:]) END
  FROM (SELECT k.*, ln.lines, nullif(coalesce(list_position(list_transform(ln.lines, lambda x: abs((x[2] + x[4]) / 2 - (k.b + k.d) / 2) < 8), true), 0), 0) AS hit FROM ln JOIN k ON ln.document_id = k.document_id AND ln.page = k.page AND k.k = ln.k + 1)),
two AS (SELECT document_id, page, l + r > 2 * (len(lines) - l - r) AS two FROM (
  SELECT document_id, page, lines, len(list_filter(lines, lambda x: x[3] < 300)) AS l, len(list_filter(lines, lambda x: x[1] > 300 AND x[3] >= 300)) AS r FROM ln QUALIFY row_number() OVER (PARTITION BY document_id, page ORDER BY k DESC) = 1)),
cl AS (SELECT k.* EXCLUDE (k), (two AND (a + c) / 2 >= 300)::INT AS col FROM k JOIN two USING (document_id, page)),
cn AS (SELECT *, row_number() OVER (PARTITION BY document_id, page, col ORDER BY (b + d) / 2 DESC, token_no) AS k FROM cl),
rw AS (SELECT *, 0::BIGINT AS line, (b + d) / 2 AS head FROM cn WHERE k = 1
  UNION ALL SELECT cn.*, CASE WHEN abs(rw.head - (cn.b + cn.d) / 2) < 8 THEN rw.line ELSE rw.line + 1 END, CASE WHEN abs(rw.head - (cn.b + cn.d) / 2) < 8 THEN rw.head ELSE (cn.b + cn.d) / 2 END
  FROM rw JOIN cn ON rw.document_id = cn.document_id AND rw.page = cn.page AND rw.col = cn.col AND cn.k = rw.k + 1),
ro AS (SELECT document_id, page, token_no, col AS "column", line::INT AS line, (row_number() OVER (PARTITION BY document_id, page ORDER BY col, line, a, k) - 1)::INT AS rank, text FROM rw)
"""

ORACLE = {
    "p8_reading_order": "WITH " + _ORDER + "SELECT * FROM ro",
    "p9_page_text": "WITH " + _ORDER + """, w AS (SELECT document_id, page, string_agg(text, ' ' ORDER BY rank) AS words FROM ro GROUP BY ALL),
im AS (SELECT doc_id::VARCHAR AS document_id, unnest(range(1, greatest((length(text) + 399) // 400, 1) + 1))::INT AS page, ' [Image: local-asset://' || doc_id || '.png] ' AS tag FROM documents WHERE doc_id % 3 = 0)
SELECT coalesce(w.document_id, im.document_id) AS document_id, coalesce(w.page, im.page) AS page, trim(coalesce(words, '') || coalesce(tag, '')) AS text FROM w FULL JOIN im ON w.document_id = im.document_id AND w.page = im.page""",
    "v1_block_embedding": "WITH " + _LINES + _EXTRACTION["v1_hash_embedding"].replace("WITH w AS", ", w AS").replace("item_id AS id", "block_id AS id").replace("FROM benchmark", "FROM b")
    + " UNION ALL SELECT block_id, 0, 1.0 FROM b WHERE block_id NOT IN (SELECT id FROM g)",
    "s1_scan_corpus": "WITH " + _MD + "SELECT 'text' AS format, (sum(length(text)) + count(*))::BIGINT AS chars FROM md",
    "p23_to_sections": "WITH q AS (" + _EXTRACTION["p13_delineate"] + ") SELECT document_id, count(*) FILTER (block_type = 'heading') + (arg_min(block_type, sort_order) <> 'heading')::INT AS sections FROM q GROUP BY document_id",
    "p3_html_blocks": "WITH " + PLAIN_HTML + "SELECT document_id, section::INT AS section, n::INT AS sort_order, CASE WHEN kind = 'loose' THEN 'paragraph' ELSE kind END AS block_type, CASE WHEN kind = 'heading' THEN part[3]::INT END AS depth, text FROM h3",
    "l3_paginate": "WITH RECURSIVE " + _HT + """,
s AS (SELECT document_id, document_id || '/' || (sort_order // 20) AS section_id, row_number() OVER (PARTITION BY document_id, sort_order // 20 ORDER BY sort_order) AS k, block_id, text, length(text) AS n, height FROM h),
r AS (SELECT DISTINCT document_id, section_id, 1::BIGINT AS k, 0::BIGINT AS pos, 0::BIGINT AS page, 0::DOUBLE AS used, NULL::BIGINT AS p, NULL::VARCHAR AS block_id, NULL::BIGINT AS a, NULL::BIGINT AS e, NULL::BOOLEAN AS partial FROM s
UNION ALL SELECT document_id, section_id, CASE WHEN fits OR (used = 0 AND cut = n) THEN k + 1 ELSE k END, CASE WHEN fits OR (used = 0 AND cut = n) THEN 0 WHEN used > 0 THEN pos ELSE cut END,
  CASE WHEN fits THEN page ELSE page + 1 END, CASE WHEN fits THEN used + rest ELSE 0 END, CASE WHEN fits OR used = 0 THEN page END, block_id, pos, CASE WHEN fits THEN n ELSE cut END, CASE WHEN fits THEN pos > 0 ELSE true END
FROM (SELECT *, CASE WHEN want >= n THEN n WHEN q1 > 0 AND want + 1 - q1 > pos AND q1 - 1 < 30 THEN want + 1 - q1 WHEN q2 > 0 AND q2 - 1 < 30 THEN want + q2 - 1 ELSE want END AS cut FROM (
  SELECT *, instr(reverse(left(text, want + 1)), ' ') AS q1, instr(substr(text, want + 1), ' ') AS q2 FROM (
    SELECT r.document_id, r.section_id, r.k, r.pos, r.page, r.used, s.block_id, s.text, s.n, height * (n - pos) / n AS rest, used + height * (n - pos) / n <= 744 AS fits, pos + greatest(50, floor(n * (744 / height))::BIGINT) AS want
    FROM r JOIN s ON r.section_id = s.section_id AND r.k = s.k))))
SELECT document_id, section_id, p::INT AS page, block_id, a::INT AS start, e::INT AS "end", partial AS is_partial FROM r WHERE p IS NOT NULL""",
    "l7_highlight_segments": "WITH " + _AN + f""",
o0 AS (SELECT an.block_id, b.text, annotation_id, color, unnest({_AT.format(t="b.text", n="highlighted_text")}) AS s FROM an JOIN b ON an.block_id = b.block_id),
o1 AS (SELECT *, (s >= coalesce(lag(s) OVER (PARTITION BY block_id ORDER BY s) + 12, -1))::INT AS fresh FROM o0),
o2 AS (SELECT *, sum(fresh) OVER (PARTITION BY block_id ORDER BY s) AS run FROM o1),
u AS (SELECT block_id, annotation_id, color, any_value(text) AS text, min(s) AS s, max(s) + 12 AS e FROM o2 GROUP BY block_id, annotation_id, color, run),
v AS (SELECT *, coalesce(lag(e) OVER w, 0) AS before, lead(s) OVER w IS NULL AS last FROM u WINDOW w AS (PARTITION BY block_id ORDER BY s)),
p AS (SELECT block_id, before AS pos, substr(text, before + 1, s - before) AS text, false AS is_highlighted, NULL AS color, NULL AS annotation_id FROM v UNION ALL SELECT block_id, s, substr(text, s + 1, e - s), true, color, annotation_id FROM v
  UNION ALL SELECT block_id, e, substr(text, e + 1), false, NULL, NULL FROM v WHERE last UNION ALL SELECT block_id, 0, text, false, NULL, NULL FROM b WHERE block_id NOT IN (SELECT block_id FROM u))
SELECT block_id, (row_number() OVER (PARTITION BY block_id ORDER BY pos) - 1)::INT AS n, text, is_highlighted, color, annotation_id FROM p WHERE text <> ''""",
    "d2_reanchor": "WITH " + _AN + "," + _ANCHORS + """SELECT annotation_id, block_id, start::INT AS start, (start + strlen(needle))::INT AS "end", round(greatest(0.1, least(1.0, score)), 6) AS confidence FROM y WHERE n = 1 AND score >= 0.4""",
    "d3_reanchor_loose": "WITH " + _AN.replace("an AS (", "an0 AS (") + """, an AS (SELECT * REPLACE (CASE WHEN color = 'red' THEN 'Absent Text!' ELSE upper(replace(highlighted_text, 'ß', 'ss')) END AS highlighted_text) FROM an0),""" + _ANCHORS + f""",
st AS (SELECT annotation_id, block_id, start::INT AS start, (start + strlen(needle))::INT AS "end", greatest(0.1, least(1.0, score)) AS confidence, 'strict' AS mode FROM y WHERE n = 1 AND score >= 0.4),
z AS (SELECT m.*, b.block_id, b.sort_order, b.text FROM m JOIN b ON m.document_id = b.document_id WHERE needle <> '' AND annotation_id NOT IN (SELECT annotation_id FROM st)),
n0 AS (SELECT * REPLACE (lower(p) AS p, lower(s) AS s), unnest({_AT.format(t="lower(text)", n="lower(needle)")}) AS i FROM z WHERE contains(lower(text), lower(needle))),
n1 AS (SELECT *, lower(right(left(text, i), length(prefix))) AS l, lower(substr(text, i + length(needle) + 1, length(suffix))) AS r, strlen(left(text, i)) AS start, strlen(substr(text, i + 1, length(needle))) AS size FROM n0),
n2 AS (SELECT *, 0.4::DOUBLE + CASE WHEN p <> '' AND l <> '' AND (contains(l, right(p, 10)) OR contains(p, right(l, 10))) THEN 0.2 ELSE 0 END + CASE WHEN s <> '' AND r <> '' AND (contains(r, left(s, 10)) OR contains(s, left(r, 10))) THEN 0.2 ELSE 0 END
  - least(0.15, abs(start - 20) / 20000.0::DOUBLE) AS confidence FROM n1),
cs AS (SELECT annotation_id, block_id, start::INT AS start, (start + size)::INT AS "end", confidence, 'case' AS mode FROM n2 QUALIFY row_number() OVER (PARTITION BY annotation_id ORDER BY confidence DESC, sort_order, block_id, start) = 1),
p0 AS (SELECT *, strlen(left(text, instr(text, p) - 1 + length(p))) AS start FROM z WHERE p <> '' AND contains(text, p) AND annotation_id NOT IN (SELECT annotation_id FROM cs WHERE confidence >= 0.4)),
px AS (SELECT annotation_id, block_id, start::INT AS start, least(start + strlen(needle), strlen(text))::INT AS "end", 0.4::DOUBLE AS confidence, 'prefix' AS mode FROM p0 QUALIFY row_number() OVER (PARTITION BY annotation_id ORDER BY sort_order, block_id, start) = 1),
a AS (SELECT * FROM st UNION ALL SELECT * FROM cs WHERE annotation_id NOT IN (SELECT annotation_id FROM px) UNION ALL SELECT * FROM px)
SELECT * REPLACE (round(confidence, 6) AS confidence) FROM a""",
}

"""Queries over search texts, vector caches, HTML structure, stores and call states, with oracle SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import text as tx
from vellumspark.operators import extract as ex
from vellumspark.operators import notes as no
from vellumspark.operators import reflow as rf
from vellumspark.operators import search as se
from vellumspark.operators import store as st
from vellumspark.operators import toolog as tl
from vellumspark.plans.extraction import _COS, _LINES, _TARGET, _TOKENS, _tokens, line_blocks, texts
from vellumspark.plans.records import _annotations
from vellumspark.session import shared_dir, table
from vellumspark.sources import files

#: Search texts: all the syntax at once, and one that doesn't read and is searched as a phrase.
_SEARCH = '"of the" ther* NOT with from OR "the the"'
_STRAY = "of, the"


def _block_cache(s: SparkSession, d: str) -> DataFrame:
    """Embeddings as vectors of the first lines of documents: [block_id, vector]."""
    return table(s, d, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit("-0")).alias("block_id"), F.col("embedding").alias("vector"))


def _groups(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Pages with an image, a table and a quote behind their first tag: [document_id, html]."""
    number = F.col("page_id").cast("string")
    extra = F.concat(
        F.lit("<h2> </h2><IMG class='x' alt=\"a page\" src=\"p"), number, F.lit(".png\"><img src='q.png'><table><tr><th>Key</th><td class=\"n\"> "), number,
        F.lit(" </td></tr></table><blockquote>\nurl "), number, F.lit("</blockquote>"),
    )
    return table(s, d, "pages").select(number.alias("document_id"), F.concat(extra, "html").alias("html"))


#: Files that one task writes.
_FILES = 1000


def _assets(s: SparkSession, d: str) -> DataFrame:
    """A file for each supplier, scanned as assets: its digest, and whether the URI is made of digest and name."""
    path = f"{shared_dir(s)}/assets-{uuid.uuid4().hex}"
    suppliers = table(s, d, "supplier").select("s_suppkey", "s_name")
    # a number of its own: the rows are small, so Spark would leave all their files to one task
    tasks = max(s.sparkContext.defaultParallelism, suppliers.count() // _FILES)
    suppliers.repartition(tasks, "s_suppkey").write.partitionBy("s_suppkey").text(path)
    found = files.scan_assets(s, path)  # no pattern, whose folders would be listed one by one
    named = F.col("local_uri") == F.concat(F.lit("local-asset://"), "sha256", F.lit("_"), "image_id", F.lit(".png"))
    return found.select(F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("long").alias("s_suppkey"), "sha256", named.alias("named"))


def _caps(s: SparkSession, d: str) -> DataFrame:
    """Whole documents as single pages: their capped text and number of capped tokens."""
    words = texts(s, d).select("document_id", F.lit(1).alias("page"), F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), 0)).alias("token_no", "text"))
    tokens = rf.cap_pages(words).groupBy("document_id").agg(F.count("*").alias("tokens"))
    return texts(s, d).select("document_id", rf.cap_text(F.col("text")).alias("text")).join(tokens.hint("merge"), "document_id", "left")


def _nine(s: SparkSession, d: str, word: str) -> dict[str, DataFrame]:
    """The nine tables of a store, whose values start with ``word``."""
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "source", "lang")
    blocks = line_blocks(s, d)

    def value(c: str) -> F.Column:
        return F.concat(F.lit(f"{word} "), c)

    return {
        "documents": docs.select(F.col("document_id").alias("id"), value("source").alias("title")),
        "sections": docs.select(F.concat(F.lit("s"), "document_id").alias("id"), "document_id", value("lang").alias("title")),
        "blocks": blocks.select(F.col("block_id").alias("id"), "document_id", value("text").alias("content")),
        "processing_jobs": docs.select(F.concat(F.lit("j"), "document_id").alias("id"), "document_id", F.lit(word).alias("status")),
        "job_chunks": blocks.select(F.concat(F.lit("c"), "block_id").alias("id"), F.concat(F.lit("j"), "document_id").alias("job_id"), F.lit(word).alias("status")),
        "tags": docs.select(F.col("source").alias("id"), value("source").alias("name"), F.lit(word).alias("source")).distinct(),
        "block_tags": docs.select(F.concat("document_id", F.lit("-0")).alias("block_id"), F.col("source").alias("tag_id")),
        "annotations": blocks.select(F.concat(F.lit("n"), "block_id").alias("id"), "document_id", F.lit(word).alias("note_body"), F.lit(word).alias("highlighted_text"), F.lit(word).alias("anchor_metadata"), F.lit(1).alias("updated_at"), F.lit(word).alias("color_code")),
        "layout_height_cache": blocks.select("block_id", F.lit(100.5 if word == "new" else 1.0).alias("estimated_height")),
    }


def _promote_all(s: SparkSession, d: str) -> DataFrame:
    """Every fifth document promoted into a store of the even ones; all nine tables published, read back and listed."""
    even = {"documents": "CAST(id AS BIGINT) % 2 = 0", "job_chunks": "CAST(substr(job_id, 2) AS BIGINT) % 2 = 0", "block_tags": "CAST(split(block_id, '-')[0] AS BIGINT) % 2 = 0", "layout_height_cache": "CAST(split(block_id, '-')[0] AS BIGINT) % 2 = 0"}
    content = {name: rows if name == "tags" else rows.where(even.get(name, "CAST(document_id AS BIGINT) % 2 = 0")) for name, rows in _nine(s, d, "old").items()}
    ids = texts(s, d).where("CAST(document_id AS BIGINT) % 5 = 0").select("document_id")
    path = f"{shared_dir(s)}/store-{uuid.uuid4().hex}"
    st.publish(st.promote(_nine(s, d, "new"), content, ids), path, 1)
    shown = {
        "documents": ("id", "title"), "sections": ("id", "title"), "blocks": ("id", "content"), "processing_jobs": ("id", "status"), "job_chunks": ("id", "status"), "tags": ("id", "concat(name, '/', source)"),
        "block_tags": ("block_id", "tag_id"), "annotations": ("id", "concat(note_body, '/', color_code)"), "layout_height_cache": ("block_id", "CAST(estimated_height AS STRING)"),
    }
    out = None
    for name, rows in st.published(s, path).items():
        key, value = shown[name]
        listed = rows.select(F.lit(name).alias("name"), F.col(key).alias("id"), F.expr(value).alias("value"))
        out = listed if out is None else out.unionByName(listed)
    return out


def _chunks_of(s: SparkSession, d: str) -> DataFrame:
    """Chunks (order lines) whose job (order) belongs to a customer with an odd number."""
    jobs = table(s, d, "orders").where("o_custkey % 2 = 1").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(s, d, "lineitem").join(jobs.hint("merge"), "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


def _agent_log(s: SparkSession, d: str) -> DataFrame:
    """Events as an agent's texts: calls by event kind, a question, completions in other spellings, nameless JSON and prose."""
    e = table(s, d, "events")
    n = F.col("event_id") % 40
    name = F.when(n == 0, "ASKHUMAN").when(n == 1, "parseComplete").when(n == 2, "ParsingComplete").when(n < 20, "CreateNode").when(n < 25, "read_content_db").otherwise(F.col("event_type"))
    body = F.when(n == 30, F.lit('{"args": 1}')).when(n == 31, F.lit("I think")).when(n == 32, F.lit("so {{ it")).otherwise(F.concat(F.lit('I call {"tool": "'), name, F.lit('", "args": {}} now')))
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), "ts", body.alias("content"))


def _agent_status(s: SparkSession, d: str) -> DataFrame:
    log = _agent_log(s, d)
    failures = log.where("seq % 3 = 0").select("session_id", "seq")
    return tl.session_status(tl.call_results(tl.extract_calls(log), log, failures))


QUERIES = {
    "f3_search_text": lambda s, d: se.search(_tokens(s, d), _SEARCH),
    "f5_phrase_fallback": lambda s, d: se.search(_tokens(s, d), _STRAY),
    "j2_search_with_titles": lambda s, d: se.search_with_titles(_tokens(s, d), line_blocks(s, d), table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title")), "the with"),
    "j3_block_vectors": lambda s, d: se.block_vectors(line_blocks(s, d), _block_cache(s, d)).select("document_id", "id", F.size("vector").alias("size"), F.element_at("vector", 1).alias("first"), F.length("text").alias("chars")),
    "j4_chunks_of_jobs": _chunks_of,
    "q4_anchored": lambda s, d: no.anchored(_annotations(s, d).withColumn("block_id", F.when(F.col("color") == "red", F.col("block_id")))).select("annotation_id", "block_id"),
    "v3_nearest": lambda s, d: se.nearest(_groups(s, d).where("id % 20 = 0"), _groups(s, d), "label", 5).withColumn("score", F.round("score", 6)),
    "v4_dot": lambda s, d: table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(tx.dot(F.col("embedding"), F.array(*[F.lit(x) for x in _TARGET])), 6).alias("score")),
    "s6_scan_assets": _assets,
    "p3_html_sections": lambda s, d: ex.html_sections(_pages(s, d)),
    "p3_html_structure": lambda s, d: ex.html_structure(_pages(s, d)).withColumn("semantic_tags", F.array_join("semantic_tags", ",")),
    "p6_html_images": lambda s, d: ex.html_images(_pages(s, d)),
    "p12_caps": _caps,
    "m1_promote_all": _promote_all,
    "a3_agent_calls": lambda s, d: tl.extract_calls(_agent_log(s, d)).select("session_id", "seq", "tool", "status"),
    "a4_agent_status": _agent_status,
}

_HTML = r"""
pg AS (SELECT page_id::VARCHAR AS document_id, '<h2> </h2><IMG class=''x'' alt="a page" src="p' || page_id || '.png"><img src=''q.png''><table><tr><th>Key</th><td class="n"> ' || page_id || ' </td></tr></table><blockquote>'
  || chr(10) || 'url ' || page_id || '</blockquote>' || regexp_replace(regexp_replace(html, '(?s)<head(?:>|[ \n][^>]*>).*?</head>', '', 'g'), '(?s)<script(?:>|[ \n][^>]*>).*?</script>', '', 'g') AS html FROM pages),
h0 AS (SELECT document_id, regexp_extract_all(html, '(?s)<h1(?:>|\s[^>]*>).*?</h1>|<h2(?:>|\s[^>]*>).*?</h2>|<h3(?:>|\s[^>]*>).*?</h3>|<p(?:>|\s[^>]*>).*?</p>|<table>.*?</table>|<blockquote>.*?</blockquote>|<[^>]*>|[^<]+') AS a FROM pg),
h1 AS (SELECT document_id, unnest(a) AS part, generate_subscripts(a, 1) AS pos FROM h0),
h2 AS (SELECT *, CASE WHEN regexp_matches(part, '(?s)^<h[1-3].*</h[1-3]>$') THEN 'heading' WHEN regexp_matches(part, '(?s)^<p[\s>].*</p>$') THEN 'paragraph' WHEN regexp_matches(part, '(?s)^<table>.*</table>$') THEN 'table'
  WHEN regexp_matches(part, '(?s)^<blockquote>.*</blockquote>$') THEN 'quote' WHEN starts_with(lower(part), '<img ') THEN 'image' WHEN NOT starts_with(part, '<') AND regexp_replace(part, '^\s+|\s+$', '', 'g') <> '' THEN 'loose' END AS kind FROM h1),
h3 AS (SELECT *, regexp_replace(CASE WHEN kind = 'loose' THEN part ELSE regexp_extract(part, '(?s)^<[^>]*>(.*)</[a-z0-9]+>$', 1) END, '^\s+|\s+$', '', 'g') AS text, sum((kind = 'heading')::INT) OVER w AS section, sum((kind = 'image')::INT) OVER w AS image,
  row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1 AS n FROM h2 WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY document_id ORDER BY pos)),
h4 AS (SELECT *, sha256(CASE WHEN image = 1 THEN 'p' || document_id || '.png' ELSE 'q.png' END) AS digest, CASE WHEN image = 1 THEN 'a page' ELSE '' END AS alt FROM h3)
"""
#: The same over pages as they are.
PLAIN_HTML = re.sub(r"'<h2>.*?</blockquote>' \|\| ", "", _HTML, flags=re.S)
_NODE = "'{\"type\":\"text\",\"text\":' || to_json({0})::VARCHAR || ',\"bold\":null,\"italic\":null,\"code\":null}'"
_DOC = "split_part(b.block_id, '-', 1)::BIGINT"

ORACLE = {
    "f3_search_text": "WITH " + _TOKENS + """,
t3 AS (SELECT a.document_id, a.block_id, bool_or(a.term = 'of' AND b.term = 'the') AS p, bool_or(a.term = 'the' AND b.term = 'the') AS r, bool_or(starts_with(a.term, 'ther')) AS x, bool_or(a.term = 'with') AS w, bool_or(a.term = 'from') AS f
  FROM tk a LEFT JOIN tk b ON a.block_id = b.block_id AND b.pos = a.pos + 1 GROUP BY ALL)
SELECT document_id, block_id FROM t3 WHERE (coalesce(p, false) AND x AND NOT (w AND f)) OR coalesce(r, false)""",
    "f5_phrase_fallback": "WITH " + _TOKENS + "SELECT DISTINCT a.document_id, a.block_id FROM tk a JOIN tk b ON a.block_id = b.block_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'",
    "j2_search_with_titles": "WITH " + _TOKENS + """, m AS (SELECT block_id FROM tk WHERE term IN ('the', 'with') GROUP BY ALL HAVING count(DISTINCT term) = 2)
SELECT b.block_id AS id, b.text AS content, d.source AS doc_title FROM b JOIN m USING (block_id) JOIN documents d ON d.doc_id::VARCHAR = b.document_id""",
    "j3_block_vectors": "WITH " + _LINES + "SELECT document_id, block_id AS id, len(embedding)::INT AS size, embedding[1] AS first, length(text)::INT AS chars FROM b JOIN embeddings ON block_id = vec_id || '-0'",
    "j4_chunks_of_jobs": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 1)",
    "q4_anchored": "WITH " + _LINES + "SELECT 'n' || block_id AS annotation_id, block_id FROM b WHERE length(text) > 60 AND sort_order % 2 = 0",
    "v3_nearest": """WITH p AS (SELECT q.vec_id AS target_id, c.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 20 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY target_id ORDER BY score DESC, id))::INT AS rank FROM p) SELECT target_id, rank, id, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "v4_dot": f"SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], {_TARGET}::DOUBLE[]), 6) AS score FROM embeddings",
    "s6_scan_assets": "SELECT s_suppkey, sha256(s_name || chr(10)) AS sha256, true AS named FROM supplier",
    "p3_html_sections": "WITH " + _HTML + """SELECT document_id, 'sec-' || document_id || '-default' AS id, NULL::VARCHAR AS parent_id, 'Default Section' AS title, 1::INT AS depth_level, 0::INT AS sort_order FROM pg
UNION ALL SELECT document_id, 'sec-html-' || document_id || '-' || section, NULL, text, part[3]::INT, section::INT FROM h4 WHERE kind = 'heading'""",
    "p3_html_structure": "WITH " + _HTML + """SELECT document_id, 'block-html-' || document_id || '-' || n AS id, CASE WHEN section = 0 THEN 'sec-' || document_id || '-default' ELSE 'sec-html-' || document_id || '-' || section END AS section_id,
CASE WHEN kind = 'loose' THEN 'paragraph' ELSE kind END AS block_type,
CASE kind WHEN 'heading' THEN '{"type":"heading","level":' || part[3] || ',"children":[' || T1 || ']}' WHEN 'quote' THEN '{"type":"quote","children":[' || T1 || ']}'
  WHEN 'table' THEN '{"type":"table","rows":[{"cells":[{"children":[' || T2 || '],"is_header":true},{"children":[' || T3 || '],"is_header":null}]}]}'
  WHEN 'image' THEN '{"type":"image","src":"local-asset://' || digest || '_img-html-' || image || '.png","alt":' || CASE WHEN alt = '' THEN 'null' ELSE to_json(alt)::VARCHAR END || ',"caption":null}'
  ELSE '{"type":"paragraph","children":[' || T1 || ']}' END AS content, n::INT AS sort_order, CASE WHEN kind IN ('loose', 'paragraph') THEN '' ELSE kind END AS semantic_tags FROM h4""".replace("T1", _NODE.replace("{0}", "text")).replace("T2", _NODE.replace("{0}", "'Key'")).replace("T3", _NODE.replace("{0}", "document_id")),
    "p6_html_images": "WITH " + _HTML + "SELECT document_id, 'img-html-' || image AS image_id, digest AS sha256_hash, 'local-asset://' || digest || '_img-html-' || image || '.png' AS local_uri, alt FROM h4 WHERE kind = 'image'",
    "p12_caps": r"""WITH d AS (SELECT doc_id::VARCHAR AS document_id, text, len(regexp_extract_all(text, '\S+')) AS words FROM documents),
c AS (SELECT document_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS n FROM d WHERE strlen(text) > 100000),
r AS (SELECT *, sum(strlen(c)) OVER (PARTITION BY document_id ORDER BY n) AS bytes FROM c),
k AS (SELECT document_id, string_agg(c, '' ORDER BY n) AS cut FROM r WHERE bytes <= 100000 GROUP BY document_id)
SELECT document_id, coalesce(cut, text) AS text, CASE WHEN words > 0 THEN least(words, 1000) END AS tokens FROM d LEFT JOIN k USING (document_id)""",
    "m1_promote_all": "WITH " + _LINES + f""",
x AS (SELECT doc_id, source, lang, doc_id % 5 = 0 AS fresh FROM documents WHERE doc_id % 5 = 0 OR doc_id % 2 = 0),
y AS (SELECT b.*, {_DOC} % 5 = 0 AS fresh FROM b WHERE {_DOC} % 5 = 0 OR {_DOC} % 2 = 0)
SELECT 'documents' AS name, doc_id::VARCHAR AS id, CASE WHEN fresh THEN 'new ' ELSE 'old ' END || source AS value FROM x
UNION ALL SELECT 'sections', 's' || doc_id, CASE WHEN fresh THEN 'new ' ELSE 'old ' END || lang FROM x
UNION ALL SELECT 'blocks', block_id, CASE WHEN fresh THEN 'new ' ELSE 'old ' END || text FROM y
UNION ALL SELECT 'processing_jobs', 'j' || doc_id, CASE WHEN fresh THEN 'new' ELSE 'old' END FROM x
UNION ALL SELECT 'job_chunks', 'c' || block_id, CASE WHEN fresh THEN 'new' ELSE 'old' END FROM y
UNION ALL SELECT DISTINCT 'tags', source, 'new ' || source || '/old' FROM documents
UNION ALL SELECT 'block_tags', doc_id || '-0', source FROM documents
UNION ALL SELECT 'annotations', 'n' || block_id, CASE WHEN fresh AND {_DOC} % 2 = 0 THEN 'new/old' WHEN fresh THEN 'new/new' ELSE 'old/old' END FROM y b
UNION ALL SELECT 'layout_height_cache', block_id, '100.5' FROM b""",
    "a3_agent_calls": """SELECT user_id AS session_id, event_id AS seq, CASE WHEN event_id % 40 IN (30, 31, 32) THEN NULL WHEN event_id % 40 = 0 THEN 'ASKHUMAN' WHEN event_id % 40 = 1 THEN 'parseComplete' WHEN event_id % 40 = 2 THEN 'ParsingComplete' WHEN event_id % 40 < 20 THEN 'CreateNode'
  WHEN event_id % 40 < 25 THEN 'read_content_db' ELSE event_type END AS tool, CASE event_id % 40 WHEN 30 THEN 'nameless' WHEN 31 THEN 'malformed' WHEN 32 THEN 'malformed' ELSE 'ok' END AS status FROM events""",
    "a4_agent_status": """WITH e AS (SELECT user_id, event_id, ts, event_id % 40 AS n, event_id % 3 = 0 AS hit FROM events),
r AS (SELECT *, n IN (1, 2) AS done, n >= 25 OR (hit AND n NOT IN (1, 2)) AS failed FROM e),
i AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM r),
k AS (SELECT *, sum(failed::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM i),
t AS (SELECT *, CASE WHEN done AND hit THEN 'error' WHEN done THEN 'completed' WHEN (n = 0 AND NOT hit) OR streak >= 3 THEN 'waiting' END AS event FROM k)
SELECT user_id AS session_id, coalesce(first(event ORDER BY ts, event_id) FILTER (event IS NOT NULL), 'running') AS status, first(event_id ORDER BY ts, event_id) FILTER (event IS NOT NULL) AS seq FROM t GROUP BY user_id""",
}

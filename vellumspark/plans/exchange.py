"""Queries over tree rows, the inverted index, wire packets, backups, recorded reads and contexts, with oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators import extract as ex
from vellumspark.operators import notes as no
from vellumspark.operators import postings
from vellumspark.operators import search as se
from vellumspark.operators import store as st
from vellumspark.operators import toolog as tl
from vellumspark.operators import tree
from vellumspark.plans import extraction, trees
from vellumspark.plans.extraction import line_blocks, texts
from vellumspark.plans.records import _AN, _B, _PACKETS, _TAGS, _annotations, _block_tags, _packets
from vellumspark.session import materialise, shared_dir, table
from vellumspark.sources import backup


def _tree_rows(s: SparkSession, d: str) -> DataFrame:
    rows, _ = tree.tree_rows(trees._trees(s, d))
    return rows.select("block_id", "path", "key", "value")


def _index(s: SparkSession, d: str) -> str:
    """The inverted index of all lines; gives its folder."""
    path = f"{shared_dir(s)}/postings-{uuid.uuid4().hex}"
    postings.build(line_blocks(s, d), path)
    return path


def _search(s: SparkSession, d: str, find: Callable[[DataFrame, str], DataFrame], query: str) -> DataFrame:
    return find(postings.tokens(s, _index(s, d), se._words(query)), query)


#: Words of context for a question.
BUDGET = 500


def _context(s: SparkSession, d: str) -> DataFrame:
    lines = texts(s, d).select("document_id", F.posexplode(F.split("text", "\n")).alias("sort_order", "text"))
    blocks = se.offsets(lines, "sort_order", 1).where("text <> ''").select("document_id", F.concat("document_id", F.lit("-"), F.col("sort_order").cast("string")).alias("id"), "begin", "end")
    chunks = se.offsets(ex.chunk(texts(s, d)), "seq", 2)
    return se.answer_context(extraction.QUERIES["v7_hybrid_search"](s, d), blocks, chunks, BUDGET)


def _wire(s: SparkSession, d: str) -> DataFrame:
    """Documents sent as lines: an early other packet of every first index, and three damaged lines a document."""
    wire = materialise(no.to_wire(_packets(s, d), "n"), "sent-lines")
    sent = wire.drop("n").withColumn("arrival", F.col("i") + 100)
    early = no.packetise(table(s, d, "documents").where("text <> ''").select(F.col("doc_id").alias("tx"), F.lit("an early | text").alias("payload")))
    # the early packet claims the true number of packets
    early = no.to_wire(early.drop("n").join(wire.where("i = 0").select("tx", "n").hint("merge"), "tx").select("tx", "i", "n", "checksum", "data")).withColumn("arrival", F.col("i"))
    first = sent.where("i = 0")
    damaged = [F.expr("substring_index(line, '|', 3)"), F.expr("replace(line, concat(tx, '|0|'), concat(tx, '|x|'))"), F.concat("line", F.lit("|"))]
    lines = sent.unionByName(early).select("arrival", "line")
    for n, line in enumerate(damaged):
        lines = lines.unionByName(first.select((F.col("arrival") + n + 1000).alias("arrival"), line.alias("line")))
    packets, rejects = no.from_wire(lines)
    whole = no.reassemble(packets, checked=True).select(F.col("tx").alias("name"), "progress", "payload")
    return whole.unionByName(rejects.groupBy(F.col("reason").alias("name")).agg(F.count("*").cast("double").alias("progress"), F.lit(None).cast("string").alias("payload")))


def _backup(s: SparkSession, d: str) -> DataFrame:
    """A backup of every document, some payloads changed to other versions or damaged, read back from its files."""
    docs = table(s, d, "documents")
    documents = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.col("lang").alias("title"), F.col("source").alias("source_type"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256_hash"))
    notes = _annotations(s, d).where("CAST(document_id AS BIGINT) % 3 <> 0")
    notes = notes.select("document_id", F.col("annotation_id").alias("id"), "highlighted_text", F.col("prefix").alias("note_body"), F.col("color").alias("color_code"), F.lit("highlight").alias("annotation_type"))
    tags = notes.select(F.col("id").alias("annotation_id"), F.explode(F.array("color_code", F.lit("note"))).alias("name"))
    n, payload = F.col("document_id").cast("long") % 7, F.col("payload_json")
    older = F.regexp_replace(F.regexp_replace(payload, r',"tags":\[[^\]]*\]', ""), '^\\{"schema_version":2', '{"unknown":{"a":[1]},"schema_version":1')
    changed = F.when(n == 0, F.expr("left(payload_json, length(payload_json) - 5)")).when(n == 1, older).when(n == 2, F.replace(payload, F.lit('"schema_version":2'), F.lit('"schema_version":9')))
    changed = changed.when(n == 3, F.replace(payload, F.lit('"sha256_hash"'), F.lit('"hash"'))).otherwise(payload)
    path = f"{shared_dir(s)}/backup-{uuid.uuid4().hex}"
    backup.write(backup.payloads(documents, notes, tags).withColumn("payload_json", changed), path)
    found, annotations, rejects = backup.read(s, path)
    none = F.lit(None).cast("string")
    return (
        found.select(F.lit("document").alias("kind"), "document_id", F.concat_ws("/", "schema_version", "title", "source_type").alias("value"))
        .unionByName(annotations.select(F.lit("note").alias("kind"), F.col("id").alias("document_id"), F.concat_ws("/", "highlighted_text", "note_body", F.array_join("tags", ",")).alias("value")))
        .unionByName(rejects.groupBy(F.lit("reject").alias("kind"), none.alias("document_id"), "reason").agg(F.count("*").alias("n")).select("kind", "document_id", F.concat_ws("/", "reason", "n").alias("value")))
    )


def _reads(s: SparkSession, d: str) -> DataFrame:
    """Events as recorded reads of a log in which every order creates a block of its customer."""
    tool = F.element_at(F.array(F.lit("read_content_db"), F.lit("Query_Vector_DB"), F.lit("QueryAgentDB"), F.lit("readcontentdb")), (F.col("event_id") % 4 + 1).cast("int"))
    args = F.to_json(F.struct((F.col("user_id") * 2).cast("string").alias("chunk_id"), F.substring("event_type", 1, 2).alias("query")))
    calls = table(s, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("document_id"), tool.alias("tool"), args.alias("args"))
    chunks = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").cast("string").alias("document_id"), F.col("c_mktsegment").alias("text"))
    created = table(s, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("document_id"), F.col("o_orderkey").cast("string").alias("id"))
    return tl.run_reads(calls, {"chunks": chunks, "created": created})


def _names(s: SparkSession, d: str) -> DataFrame:
    """Agent states where three of five tools are registered: names with underscores in any case, and two that aren't."""
    e = table(s, d, "events")
    tool = F.element_at(F.array(*[F.lit(x) for x in ("query_vector_db", "Read_Content_DB", "queryvectordb", "readcontentdb", "CreateTag")]), (F.length("event_type") % 5 + 1).cast("int"))
    log = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), "ts", F.concat(F.lit('{"tool":"'), tool, F.lit('"}')).alias("content"))
    none = log.where(F.lit(False)).select("session_id", "seq")
    return tl.session_status(tl.call_results(tl.extract_calls(log), log, none))


def length_hook() -> Callable[[str], str]:
    """Answers with a call that names the length of the prompt; fails on an empty one."""

    def answer(text: str) -> str:
        if not text:
            raise ValueError("nothing to answer")
        return f'Sure: {{"tool": "CreateTag", "args": {{"n": {len(text)}}}}}'

    return answer


def _hooked(s: SparkSession, d: str) -> DataFrame:
    log = table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "text")
    answered = tl.with_hook(log, "text", "content", "length", length_hook)
    return tl.extract_calls(answered.withColumn("content", F.coalesce("content", F.lit("")))).select("session_id", "seq", "tool", "args", "status")


def _tag_sources(s: SparkSession, d: str) -> DataFrame:
    tags = _block_tags(s, d).select(F.col("tag_id").alias("id"), F.upper("tag_id").alias("name"), F.when(F.col("tag_id").contains("-"), "user").otherwise("system").alias("source")).distinct()
    return no.tags_with_authors(tags, _block_tags(s, d), table(s, d, "documents").select(F.col("doc_id").alias("block_id"), F.col("lang").alias("author_id")))


def _rules(s: SparkSession, d: str) -> DataFrame:
    """A store in which every rule is broken: names that repeat, ids that repeat, missing titles, documents of an unknown corpus."""
    docs = table(s, d, "documents")
    new = {
        "corpora": docs.select(F.col("source").alias("id"), F.col("source").alias("name")).distinct().where("id <> 'src1'"),
        "documents": docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("corpus_id"), F.when(F.col("doc_id") % 11 > 0, F.col("lang")).alias("title")),
        "tags": docs.select(F.col("source").alias("id"), F.left("source", F.lit(1)).alias("name")).distinct(),
        "blocks": line_blocks(s, d).select(F.col("block_id").alias("id"), "document_id", F.col("text").alias("content")),
    }
    new["blocks"] = new["blocks"].unionByName(new["blocks"].where("CAST(document_id AS BIGINT) % 17 = 0"))
    full = {name: st.with_defaults(name, rows) for name, rows in new.items()}
    types = full["documents"].groupBy("source_type").agg(F.count("*").alias("count")).unionByName(full["blocks"].groupBy(F.col("block_type").alias("source_type")).agg(F.count("*").alias("count")))
    report = st.integrity_report(full, {"documents": ["id"], "blocks": ["id"], "corpora": ["id"]})
    return report.unionByName(types.select(F.lit("all").alias("table"), F.lit("default").alias("rule"), F.col("source_type").alias("key"), "count"))


def _delta(s: SparkSession, d: str) -> DataFrame:
    """Events whose time is written in four ways, changed since a time."""
    e = table(s, d, "events").withColumn("t", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    plain, ahead = F.date_format("t", "yyyy-MM-dd HH:mm:ss"), F.date_format(F.col("t") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 5
    written = F.when(k == 0, plain).when(k == 1, F.concat(F.replace(plain, F.lit(" "), F.lit("T")), F.lit(".000Z"))).when(k == 2, F.concat(ahead, F.lit("+02:00"))).when(k == 3, F.replace(plain, F.lit(" "), F.lit("T"))).otherwise("soon")
    middle = e.agg(F.min("t") + (F.max("t") - F.min("t")) / 2).first()[0].replace(microsecond=0)
    return st.delta_since(e.select("event_id", written.alias("updated_at")), "updated_at", middle.strftime("%Y-%m-%dT%H:%M:%SZ")).select("event_id")


QUERIES = {
    "m7_rules": _rules,
    "m9_delta_times": _delta,
    "p20_tree_rows": _tree_rows,
    "p20_index_from_rows": lambda s, d: tree.index_text(trees._trees(s, d), tree.tree_rows(trees._trees(s, d))[0]),
    "f2_index_match": lambda s, d: _search(s, d, se.match, "the With"),
    "f3_index_phrase": lambda s, d: _search(s, d, se.match_phrase, "of the"),
    "v9_question_context": _context,
    "d7_wire": _wire,
    "s5_backup_files": _backup,
    "a2_reads_as_of": _reads,
    "a4_tool_names": _names,
    "a1_hooked_calls": _hooked,
    "g1_tags_with_sources": _tag_sources,
}

_TREE = r"""'{"type":"paragraph","children":[{"type":"text","text":' || to_json(text)::VARCHAR || ',"bold":null,"italic":null,"code":null},{"type":"image","src":"x","alt":"a \"text\": b","caption":null},{"type":"text","text":"end","code":true}]}'"""

ORACLE = {
    "m7_rules": "WITH " + _B + """ SELECT 'documents' AS "table", 'not null' AS rule, 'title' AS "key", count(*) AS "count" FROM documents WHERE doc_id % 11 = 0 HAVING count(*) > 0
UNION ALL SELECT 'documents', 'reference', 'src1', count(*) FROM documents WHERE source = 'src1' HAVING count(*) > 0
UNION ALL SELECT 'tags', 'unique', left(source, 1), count(DISTINCT source) FROM documents GROUP BY left(source, 1) HAVING count(DISTINCT source) > 1
UNION ALL SELECT 'blocks', 'unique', block_id, 2 FROM b WHERE document_id::BIGINT % 17 = 0
UNION ALL SELECT 'all', 'default', 'pdf', count(*) FROM documents UNION ALL SELECT 'all', 'default', 'paragraph', count(*) + count(*) FILTER (document_id::BIGINT % 17 = 0) FROM b""",
    "m9_delta_times": "WITH e AS (SELECT event_id, date_trunc('second', ts) AS t FROM events) SELECT event_id FROM e WHERE event_id % 5 < 4 AND t > (SELECT date_trunc('second', min(t) + (max(t) - min(t)) / 2) FROM e)",
    "p20_tree_rows": "WITH " + _B + f", c AS (SELECT block_id, {_TREE} AS content FROM b WHERE sort_order % 5 <> 4)" + """
SELECT block_id, fullkey AS path, key, CASE WHEN type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN atom ->> '$' END AS value FROM c, json_tree(c.content) t WHERE fullkey <> '$'""",
    "p20_index_from_rows": trees.ORACLE["p20_index_text"],
    "f2_index_match": extraction.ORACLE["f2_match"],
    "f3_index_phrase": extraction.ORACLE["f3_phrase"],
    "v9_question_context": f"WITH ranked AS ({extraction.ORACLE['v7_hybrid_search']}), pieces AS ({extraction.ORACLE['p14_chunk']})," + r"""
l AS (SELECT doc_id::VARCHAR AS document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
k AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY pos) AS upto FROM l),
c AS (SELECT document_id, seq, text, word_count, sum(length(text) + 2) OVER (PARTITION BY document_id ORDER BY seq) AS upto FROM pieces),
h AS (SELECT c.document_id, c.seq, min(rank) AS best FROM c JOIN k ON c.document_id = k.document_id AND k.line <> '' AND k.upto - length(line) - 1 < c.upto - 2 AND c.upto - 2 - length(c.text) < k.upto - 1
  JOIN ranked r ON r.document_id = k.document_id AND r.id = k.document_id || '-' || k.pos GROUP BY ALL),
o AS (SELECT c.document_id, c.seq, (row_number() OVER w)::INT AS rank, c.text, sum(len(regexp_extract_all(c.text, '\S+'))) OVER w AS running_tokens FROM c JOIN h ON c.document_id = h.document_id AND c.seq = h.seq
  WINDOW w AS (PARTITION BY c.document_id ORDER BY best, c.seq))
""" + f"SELECT document_id, seq, rank, text, running_tokens::BIGINT AS running_tokens FROM o WHERE running_tokens <= {BUDGET}",
    "d7_wire": "WITH " + _PACKETS + """, n AS (SELECT count(DISTINCT tx)::DOUBLE AS n FROM pk)
SELECT doc_id::VARCHAR AS name, 100.0::DOUBLE AS progress, text AS payload FROM documents WHERE text <> '' UNION ALL SELECT r, n, NULL FROM n, (VALUES ('fields'), ('number'), ('checksum')) x(r)""",
    "s5_backup_files": "WITH " + _AN + """, d AS (SELECT doc_id, doc_id % 7 AS n, lang, source FROM documents)
SELECT 'document' AS kind, doc_id::VARCHAR AS document_id, concat_ws('/', CASE n WHEN 1 THEN 1 ELSE 2 END, lang, source) AS value FROM d WHERE n NOT IN (0, 2, 3)
UNION ALL SELECT 'note', annotation_id, concat_ws('/', highlighted_text, prefix, CASE n WHEN 1 THEN '' ELSE tags END) FROM (
  SELECT an.*, CASE color WHEN 'red' THEN 'note,red' ELSE 'blue,note' END AS tags, document_id::BIGINT % 7 AS n FROM an WHERE document_id::BIGINT % 3 <> 0) WHERE n NOT IN (0, 2, 3)
UNION ALL SELECT 'reject', NULL, CASE n WHEN 0 THEN 'damaged' WHEN 2 THEN 'newer' ELSE 'no document' END || '/' || count(*) FROM d WHERE n IN (0, 2, 3) GROUP BY n""",
    "a2_reads_as_of": """WITH e AS (SELECT event_id AS seq, user_id::VARCHAR AS document_id, event_id % 4 AS n, (user_id * 2)::VARCHAR AS chunk_id, left(event_type, 2) AS query FROM events),
k AS (SELECT c_custkey::VARCHAR AS id, c_mktsegment AS text FROM customer),
u AS (SELECT document_id, seq, 0 AS kind, NULL AS id FROM e WHERE n = 2 UNION ALL SELECT o_custkey::VARCHAR, o_orderkey, 1, o_orderkey::VARCHAR FROM orders),
w AS (SELECT *, sum(kind) OVER x AS rows, last_value(id IGNORE NULLS) OVER x AS last_id FROM u WINDOW x AS (PARTITION BY document_id ORDER BY seq, kind, id ROWS UNBOUNDED PRECEDING))
SELECT seq, 'read_content_db' AS tool, CASE WHEN text IS NULL THEN '{"error": "Chunk not found"}' ELSE '{"id":"' || chunk_id || '","text":"' || text || '"}' END AS result FROM e LEFT JOIN k ON k.id = e.chunk_id WHERE n = 0
UNION ALL SELECT seq, 'query_vector_db', coalesce('[{"id":"' || id || '","text":"' || text || '"}]', '[]') FROM e LEFT JOIN k ON k.id = e.document_id AND contains(lower(text), lower(query)) WHERE n = 1
UNION ALL SELECT seq, 'queryagentdb', '{"rows":' || rows || coalesce(',"last_id":"' || last_id || '"', '') || '}' FROM w WHERE kind = 0""",
    "a4_tool_names": """WITH e AS (SELECT user_id, event_id, ts, length(event_type) % 5 IN (2, 3) AS failed FROM events),
i AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e),
k AS (SELECT *, sum(failed::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) >= 3 AS waits FROM i)
SELECT user_id AS session_id, CASE WHEN bool_or(waits) THEN 'waiting' ELSE 'running' END AS status, first(event_id ORDER BY ts, event_id) FILTER (waits) AS seq FROM k GROUP BY user_id""",
    "a1_hooked_calls": """SELECT conv_id AS session_id, turn AS seq, CASE WHEN text <> '' THEN 'CreateTag' END AS tool, CASE WHEN text <> '' THEN '{"n":' || length(text) || '}' END AS args,
  CASE WHEN text <> '' THEN 'ok' ELSE 'malformed' END AS status FROM conversations""",
    "g1_tags_with_sources": "WITH " + _TAGS + " SELECT tag_id AS id, upper(tag_id) AS name, CASE WHEN contains(tag_id, '-') THEN 'user' ELSE 'system' END AS source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS author_ids FROM bt JOIN documents d ON d.doc_id = bt.block_id GROUP BY 1, 2",
}

"""Queries over block trees, repaired outputs, call logs, imports and sources, with oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import ast
from vellumspark.operators import extract as ex
from vellumspark.operators import notes as no
from vellumspark.operators import store as st
from vellumspark.operators import toolog as tl
from vellumspark.plans.extraction import line_blocks, markdown, texts
from vellumspark.plans.records import _AN, _B, _annotations
from vellumspark.session import shared_dir, table
from vellumspark.sources import files


def _trees(s: SparkSession, d: str) -> DataFrame:
    """Lines as paragraph trees with a code flag; every fifth stays plain text."""
    b = line_blocks(s, d)
    tree = F.concat(F.lit('{"type":"paragraph","children":['), ex.text_node(F.col("text")), F.lit(',{"type":"image","src":"x","alt":"a \\"text\\": b","caption":null},{"type":"text","text":"end","code":true}]}'))
    return b.select("block_id", F.when(F.col("sort_order") % 5 == 4, F.col("text")).otherwise(tree).alias("content"))


def _outputs(s: SparkSession, d: str) -> DataFrame:
    """Structured outputs of four kinds by event number: whole, fenced, cut off, and prose."""
    e = table(s, d, "events")
    whole = F.concat(F.lit('{"blocks":[{"block_type":"paragraph","content":{"type":"paragraph","n":'), F.col("event_id").cast("string"), F.lit("}}]}"))
    k = F.col("event_id") % 4
    cut = F.expr("left(w, length(w) - 4)")
    return e.withColumn("w", whole).select(F.col("event_id").alias("id"), F.when(k == 0, F.col("w")).when(k == 1, F.concat(F.lit("```json\n"), "w", F.lit("\n```"))).when(k == 2, cut).otherwise(F.lit('no {json "here')).alias("output"))


def _calls(s: SparkSession, d: str) -> DataFrame:
    """Orders as recorded calls: a section per customer, a block per order, priority tags and links."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("c"), F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderpriority").alias("p"))

    def call(tool: str, **args: object) -> DataFrame:
        body = F.to_json(F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(n) for n, v in args.items()]))
        return o.select("seq", F.lit(tool).alias("tool"), body.alias("args"))

    return (
        call("CreateNode", node_type="section", id=F.concat(F.lit("s"), F.col("c")), document_id=F.col("c"))
        .unionByName(call("createnode", id=F.col("k"), document_id=F.col("c"), content=F.col("p")))
        .unionByName(call("CreateTag", id=F.left("p", F.lit(1)), name=F.col("p")))
        .unionByName(call("LinkNodes", block_id=F.col("k"), tag_id=F.left("p", F.lit(1))))
    )


def _replayed(s: SparkSession, d: str) -> DataFrame:
    rows = tl.replay(_calls(s, d))
    out = [
        rows["sections"].select(F.lit("section").alias("kind"), "id", F.col("title").alias("value")),
        rows["blocks"].select(F.lit("block").alias("kind"), "id", F.concat("block_type", F.lit(":"), "content").alias("value")),
        rows["tags"].select(F.lit("tag").alias("kind"), "id", F.concat("name", F.lit(":"), "source").alias("value")),
        rows["block_tags"].select(F.lit("link").alias("kind"), F.col("block_id").alias("id"), F.col("tag_id").alias("value")),
    ]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _sections(s: SparkSession, d: str) -> DataFrame:
    sections, _ = ex.to_sections(ex.delineate(texts(s, d)))
    return sections.groupBy("document_id").agg(F.count("*").alias("sections"))


def _loose(s: SparkSession, d: str) -> DataFrame:
    a = _annotations(s, d).withColumn("highlighted_text", F.when(F.col("color") == "red", F.lit("Absent Text!")).otherwise(F.upper("highlighted_text")))
    return no.reanchor_loose(a, line_blocks(s, d)).withColumn("confidence", F.round("confidence", 6))


def _import(s: SparkSession, d: str) -> DataFrame:
    a = _annotations(s, d).withColumn("doc", F.col("document_id").cast("long"))
    content = a.where("doc % 2 = 0").withColumn("updated_at", F.lit(5)).drop("doc")
    incoming = a.withColumn("updated_at", (F.col("doc") % 10).cast("int")).withColumn("sha256_hash", F.when(F.col("doc") % 3 == 0, "other").otherwise("own"))
    incoming = incoming.withColumn("highlighted_text", F.when(F.col("doc") % 9 == 0, F.lit("absent text!")).otherwise(F.col("highlighted_text"))).drop("doc")
    documents = texts(s, d).select("document_id", F.lit("own").alias("sha256_hash"))
    return no.import_pipeline(incoming, content, documents, line_blocks(s, d))[2]


def _records(s: SparkSession, d: str) -> DataFrame:
    """Labels written as JSON lines, every seventh damaged, and read back with a schema."""
    path = f"{shared_dir(s)}/records-{uuid.uuid4().hex}"
    line = F.to_json(F.struct("doc_id", "quality"))
    table(s, d, "labels").select(F.when(F.col("doc_id") % 7 == 0, F.left(line, F.length(line) - 4)).otherwise(line).alias("value")).write.text(path)
    good, bad = files.read_records(s, path, "doc_id long, quality int")
    return good.select("doc_id", "quality", F.lit(None).cast("string").alias("error")).unionByName(bad.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("quality"), "error"))


def _sql(s: SparkSession, d: str) -> DataFrame:
    files.register({"texts": table(s, d, "documents"), "marks": table(s, d, "labels")})
    return files.run_sql(s, "WITH m AS (SELECT doc_id, max(quality) AS q FROM marks GROUP BY doc_id) SELECT lang, source, count(*) AS n, sum(q) AS good FROM texts LEFT JOIN m USING (doc_id) GROUP BY lang, source;")


def _corpus(s: SparkSession, d: str) -> DataFrame:
    """Rendered texts written as text files and scanned back by extension."""
    path = f"{shared_dir(s)}/corpus-{uuid.uuid4().hex}"
    markdown(s, d).select("text").write.text(path)
    good, rejects = files.scan_corpus(s, path)
    return good.groupBy("format").agg(F.sum(F.length("text")).alias("chars")).unionByName(rejects.groupBy(F.col("reason").alias("format")).agg(F.count("*").alias("chars")))


QUERIES = {
    "s1_scan_corpus": _corpus,
    "s3_read_records": _records,
    "q12_run_sql": _sql,
    "p17_repair_json": lambda s, d: _outputs(s, d).select("id", F.try_parse_json(tl.repair_json(F.regexp_replace("output", "```(json)?", ""))).isNotNull().alias("parses")),
    "p17_repaired_texts": lambda s, d: _outputs(s, d).select("id", tl.repair_json(F.regexp_replace("output", "```(json)?", "")).alias("repaired")).withColumn("parses", F.try_parse_json("repaired").isNotNull()),
    "p18_validate_blocks": lambda s, d: tl.validate_blocks(_outputs(s, d)).select("id", "status"),
    "p20_index_text": lambda s, d: _trees(s, d).select("block_id", ast.index_text(F.col("content")).alias("text")),
    "p21_display_text": lambda s, d: _trees(s, d).select("block_id", ast.display_text(F.col("content")).alias("text")),
    "p23_to_sections": _sections,
    "a2_replay": _replayed,
    "a3_malformed": lambda s, d: tl.malformed(tl.extract_calls(_log(s, d)), _log(s, d)).select("session_id", "seq", "error_message"),
    "d3_reanchor_loose": _loose,
    "d8_import": _import,
    "v8_put_get_vectors": lambda s, d: st.get_vectors(
        st.put_vectors(_vectors(s, d), _vectors(s, d).where("id % 3 = 0").withColumn("size", F.lit(0))), table(s, d, "labels").select(F.col("doc_id").alias("id"))
    ),
    "v8_whole_vectors": lambda s, d: st.get_vectors(
        st.put_vectors(_embeddings(s, d), _embeddings(s, d).where("id % 3 = 0").withColumn("vector", F.transform("vector", lambda x: -x))), table(s, d, "labels").select(F.col("doc_id").alias("id"))
    ).select("id", F.posexplode("vector").alias("dim", "value")),
    "m10_resolve": lambda s, d: st.resolve(
        table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("note_body")), table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.lit("merged").alias("note_body")).distinct()
    ),
}


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").alias("size"))


def _embeddings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _log(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"tool":"'), "event_type", F.lit('"}'))).otherwise(F.lit("thinking")).alias("content"))


ORACLE = {
    "s3_read_records": "SELECT doc_id, quality, NULL::VARCHAR AS error FROM labels WHERE doc_id % 7 <> 0 UNION ALL SELECT NULL, NULL, 'invalid record' FROM labels WHERE doc_id % 7 = 0",
    "q12_run_sql": """SELECT '{"lang":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || ',"n":' || count(*) || ',"good":' || coalesce(sum(q)::VARCHAR, 'null') || '}' AS json
FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY lang, source""",
    "p17_repair_json": "SELECT event_id AS id, event_id % 4 <> 3 AS parses FROM events",
    "p17_repaired_texts": """SELECT event_id AS id, CASE WHEN event_id % 4 = 3 THEN 'no {json "here"}' ELSE '{"blocks":[{"block_type":"paragraph","content":{"type":"paragraph","n":' || event_id || '}}]}' END AS repaired, event_id % 4 <> 3 AS parses FROM events""",
    "p18_validate_blocks": "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'valid' WHEN 2 THEN 'repaired' ELSE 'fallback' END AS status FROM events",
    "p20_index_text": "WITH " + _B + """ SELECT block_id, CASE WHEN sort_order % 5 = 4 THEN text ELSE text || ' a "text": b end 1' END AS text FROM b""",
    "p21_display_text": "WITH " + _B + r""" SELECT block_id, CASE WHEN sort_order % 5 = 4 THEN text ELSE trim(regexp_replace(text || ' end', '\s+', ' ', 'g')) END AS text FROM b""",
    "a2_replay": """SELECT DISTINCT 'section' AS kind, 's' || o_custkey AS id, 'Untitled' AS value FROM orders UNION ALL SELECT 'block', o_orderkey::VARCHAR, 'paragraph:' || o_orderpriority FROM orders
UNION ALL SELECT 'tag', left(o_orderpriority, 1), arg_min(o_orderpriority, o_orderkey) || ':agent' FROM orders GROUP BY left(o_orderpriority, 1) UNION ALL SELECT 'link', o_orderkey::VARCHAR, left(o_orderpriority, 1) FROM orders""",
    "a3_malformed": "SELECT user_id AS session_id, event_id AS seq, 'no tool call' AS error_message FROM events WHERE event_id % 2 = 1",
    "d8_import": "WITH " + _AN + """, x AS (SELECT *, document_id::BIGINT AS doc FROM an),
y AS (SELECT CASE WHEN doc % 3 <> 0 THEN CASE WHEN doc % 2 = 1 OR doc % 10 > 5 THEN 'applied' ELSE 'skipped' END WHEN doc % 9 = 0 THEN 'orphaned' ELSE 'reanchored' END AS s FROM x)
SELECT count(*) FILTER (s = 'applied') AS applied, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'reanchored') AS reanchored, count(*) FILTER (s = 'orphaned') AS orphaned FROM y""",
    "v8_put_get_vectors": "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE len(embedding) END::INT AS size FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)",
    "v8_whole_vectors": "SELECT vec_id AS id, (generate_subscripts(embedding, 1) - 1)::INT AS dim, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE 1 END * unnest(embedding) AS value FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)",
    "m10_resolve": "SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'merged' ELSE c_mktsegment END AS note_body FROM customer",
}

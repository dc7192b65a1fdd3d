"""Analytics over tool-call logs and conversations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.text import trimmed
from vellumspark.session import ship


def transcript(log: DataFrame) -> DataFrame:
    """[session_id, text]: ``ROLE: content`` paragraphs in order of time and number.

    One text per session is the result itself; sessions are bounded by nature.
    """
    turn = log.withColumn("_t", F.concat(F.upper("role"), F.lit(": "), "content", F.lit("\n\n")))
    return turn.groupBy("session_id").agg(F.expr("listagg(_t, '') WITHIN GROUP (ORDER BY seq)").alias("text"))


def repair_json(c: Column, aggressive: bool = False) -> Column:
    """JSON text with its open string and brackets closed, in reverse order of opening.

    The aggressive form first drops trailing commas and quotes bare keys.
    """
    text = trimmed(c)
    if aggressive:
        text = F.regexp_replace(F.regexp_replace(text, r",\s*([}\]])", "$1"), r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:", '$1"$2":')
    state = "struct<s:boolean,e:boolean,stack:string>"
    first = F.struct(F.lit(False).alias("s"), F.lit(False).alias("e"), F.lit("").alias("stack")).cast(state)

    def step(a: Column, x: Column) -> Column:
        inside = a["s"]
        quote = (x == '"') & ~a["e"]
        opened = F.when(x == "{", "}").when(x == "[", "]")
        closes = x.isin("}", "]") & a["stack"].startswith(x)
        kept = F.when(~inside & opened.isNotNull(), F.concat(opened, a["stack"])).when(~inside & closes, F.substr(a["stack"], F.lit(2), F.length(a["stack"]))).otherwise(a["stack"])
        return F.struct(F.when(quote, ~inside).otherwise(inside).alias("s"), (inside & (x == "\\") & ~a["e"]).alias("e"), kept.alias("stack")).cast(state)

    end = F.aggregate(F.filter(F.split(text, ""), lambda x: x != ""), first, step)
    return F.concat(text, F.when(end["s"], '"').otherwise(""), end["stack"])


#: Registered tools, by name in small letters (fixed values), and other names that reach them.
TOOLS = ("queryagentdb", "createnode", "linknodes", "askhuman", "parsingcomplete", "query_vector_db", "read_content_db", "createtag")
ALIASES = {"parsecomplete": "parsingcomplete"}


def registered(tool: Column) -> Column:
    """The registered name of a tool, whatever its case; null for an unknown one."""
    small = F.lower(tool)
    for alias, name in ALIASES.items():
        small = F.when(small == alias, name).otherwise(small)
    return F.when(small.isin(*TOOLS), small)


def extract_calls(log: DataFrame) -> DataFrame:
    """[session_id, seq, tool, args, status]: the tool call in a free text; status ok, repaired, nameless or malformed.

    ``nameless`` is a JSON text without a tool: a failed call of an unknown tool, not a malformed text.
    """
    start = F.instr("content", "{")
    body = F.when(start > 0, F.expr("substr(content, instr(content, '{'))"))
    tail = F.length(body) - F.instr(F.reverse(body), "}") + 1
    whole = F.when(F.contains(body, F.lit("}")), F.substr(body, F.lit(1), tail)).otherwise(body)
    # what doesn't parse is repaired from the first brace to the end, whatever closes in between
    calls = log.withColumn("_b", whole).withColumn("_r", repair_json(body, aggressive=True))
    ok = F.try_parse_json("_b")
    fixed = F.try_parse_json("_r")
    parsed = F.coalesce(ok, fixed)
    calls = calls.withColumn("_v", parsed)
    tool = F.try_variant_get("_v", "$.tool", "string")
    return calls.select(
        "session_id", "seq", tool.alias("tool"), F.try_variant_get("_v", "$.args", "string").alias("args"),
        F.when(parsed.isNull(), "malformed").when(tool.isNull(), "nameless").when(ok.isNotNull(), "ok").otherwise("repaired").alias("status"),
    )


def failure_streaks(results: DataFrame) -> DataFrame:
    """Results with ``streak``: consecutive failures up to each row; a success resets it.

    Runs are islands between successes within a session.
    """
    order = Window.partitionBy("session_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    island = results.withColumn("_i", F.sum((~F.col("failed")).cast("int")).over(order))
    inside = Window.partitionBy("session_id", "_i").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("streak", F.sum(F.col("failed").cast("int")).over(inside)).drop("_i")


def session_status(results: DataFrame, limit: int = 3) -> DataFrame:
    """[session_id, status, seq]: the first terminal event: waiting after ``limit`` failures in a row, completed, or running.

    Where the results have them, ``broken`` marks a completion whose migration failed (error) and
    ``asked`` a question to a human (waiting).
    """
    streaks = failure_streaks(results)

    def marked(name: str) -> Column:
        return F.col(name) if name in results.columns else F.lit(False)

    event = F.when(F.col("done") & marked("broken"), "error").when(F.col("done"), "completed").when(marked("asked") | (F.col("streak") >= limit), "waiting")
    terminal = streaks.withColumn("_e", event)
    first = F.struct("ts", "seq")
    grouped = terminal.groupBy("session_id").agg(F.min_by("_e", F.when(F.col("_e").isNotNull(), first)).alias("e"), F.min_by("seq", F.when(F.col("_e").isNotNull(), first)).alias("seq"))
    return grouped.select("session_id", F.coalesce("e", F.lit("running")).alias("status"), "seq")


def cached_results(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """Calls with the cached result of the same tool and inputs, if there is one."""
    keyed = calls.withColumn("inputs_hash", F.sha2(F.coalesce("args", F.lit("")), 256))
    return keyed.join(cache.dropDuplicates(["tool", "inputs_hash"]).hint("merge"), ["tool", "inputs_hash"], "left")


def best_entities(df: DataFrame) -> DataFrame:
    """[document_id, entity_type, entity_data, confidence]: the most confident candidate of each kind."""
    best = F.max(F.struct("confidence", "entity_data")).alias("b")
    return df.groupBy("document_id", "entity_type").agg(best).select("document_id", "entity_type", "b.entity_data", "b.confidence")


def job_progress(chunks: DataFrame) -> DataFrame:
    """[job_id, progress, status]: share of done chunks in percent, and the latest status."""
    return chunks.groupBy("job_id").agg((F.avg((F.col("status") == "done").cast("int")) * 100).alias("progress"), F.max_by("status", F.struct("updated_at", "chunk_order", "status")).alias("status"))


def validate_blocks(outputs: DataFrame) -> DataFrame:
    """[id, status, blocks]: structured outputs that are valid, valid after repair, or wrapped as one paragraph.

    Valid means a ``blocks`` array whose entries have a known block type and a typed content.
    """
    shape = "array<struct<block_type:string,content:struct<type:string>>>"

    def usable(c: Column) -> Column:
        listed = F.try_variant_get(F.try_parse_json(c), "$.blocks", "string")
        parsed = F.from_json(listed, shape)
        return F.coalesce(F.forall(parsed, lambda b: b["block_type"].isNotNull() & b["block_type"].isin("heading", "paragraph", "table", "code", "image", "quote", "list") & b["content"]["type"].isNotNull()), F.lit(False))

    raw = outputs.withColumn("_f", trimmed(F.regexp_replace(F.regexp_replace("output", r"^\s*```[a-z]*\s*", ""), r"\s*```\s*$", "")))
    raw = raw.withColumn("_r", repair_json(F.col("_f")))
    wrapped = F.to_json(F.array(F.struct(F.lit("paragraph").alias("block_type"), F.col("output").alias("text"), F.array(F.lit("fallback-repaired")).alias("semantic_tags"))))
    status = F.when(usable(F.col("_f")), "valid").when(usable(F.col("_r")), "repaired").otherwise("fallback")
    raw = raw.withColumn("status", status)
    chosen = F.when(F.col("status") == "valid", F.col("_f")).when(F.col("status") == "repaired", F.col("_r"))
    blocks = F.coalesce(F.try_variant_get(F.try_parse_json(chosen), "$.blocks", "string"), wrapped)
    return raw.select("id", "status", blocks.alias("blocks"))


def malformed(calls: DataFrame, log: DataFrame) -> DataFrame:
    """[session_id, seq, raw_content, error_message] of log entries without a JSON text, or with one that stays invalid after repair."""
    bad = calls.where("status = 'malformed'").select("session_id", "seq")
    why = F.when(F.contains("content", F.lit("{")), "invalid JSON").otherwise("no tool call")
    return log.join(bad.hint("merge"), ["session_id", "seq"], "left_semi").select("session_id", "seq", F.col("content").alias("raw_content"), why.alias("error_message"))


def call_results(calls: DataFrame, log: DataFrame, failures: DataFrame) -> DataFrame:
    """[session_id, ts, seq, failed, done, asked, broken] of extracted calls, as :func:`session_status` reads them.

    ``log`` gives each entry's time; ``failures`` [session_id, seq] lists calls whose tool (or, for
    a completion, whose migration) failed. Malformed, nameless and unknown calls fail by themselves.
    """
    name = registered(F.col("tool"))
    timed = calls.join(log.select("session_id", "seq", "ts").hint("merge"), ["session_id", "seq"])
    hit = failures.select("session_id", "seq", F.lit(True).alias("_hit")).distinct()
    joined = timed.join(hit.hint("merge"), ["session_id", "seq"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))).withColumn("_name", name)
    done, asked = F.coalesce(F.col("_name") == "parsingcomplete", F.lit(False)), F.coalesce(F.col("_name") == "askhuman", F.lit(False))
    return joined.select(
        "session_id", "ts", "seq", (F.col("_name").isNull() | (F.col("_hit") & ~done)).alias("failed"),
        done.alias("done"), (asked & ~F.col("_hit")).alias("asked"), (done & F.col("_hit")).alias("broken"),
    )


def replay(calls: DataFrame) -> dict[str, DataFrame]:
    """Rows that a log of calls [seq, tool, args (JSON)] creates: sections, blocks, tags, block_tags.

    Tool names match whatever their case; a repeated key keeps its first row.
    """
    v = F.try_parse_json("args")

    def arg(name: str, default: str | None = None) -> Column:
        found = F.try_variant_get(v, f"$.{name}", "string")
        return F.coalesce(found, F.lit(default)) if default is not None else found

    tool = F.lower("tool")
    nodes = calls.where(tool == "createnode").withColumn("node", F.lower(arg("node_type", "block")))

    def first(df: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("seq")
        return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "seq")

    sections = nodes.where("node = 'section'").select("seq", arg("id").alias("id"), arg("document_id").alias("document_id"), arg("title", "Untitled").alias("title"))
    blocks = nodes.where("node = 'block'").select("seq", arg("id").alias("id"), arg("document_id").alias("document_id"), arg("block_type", "paragraph").alias("block_type"), arg("content", "").alias("content"))
    tags = calls.where(tool == "createtag").select("seq", arg("id").alias("id"), arg("name").alias("name"), arg("source", "agent").alias("source"))
    links = calls.where(tool == "linknodes").select("seq", arg("block_id").alias("block_id"), arg("tag_id").alias("tag_id"))
    return {"sections": first(sections, ["id"]), "blocks": first(blocks, ["id"]), "tags": first(tags, ["id"]), "block_tags": first(links, ["block_id", "tag_id"])}


def as_of(reads: DataFrame, created: DataFrame, key: str = "document_id") -> DataFrame:
    """[seq, rows, last_id] of reads [seq, key]: how many rows [seq, key, id] were created before a read, and the last of them.

    Reads and rows are sorted together by their number, so no read is joined with rows one by one;
    a row with a read's own number was not there yet.
    """
    events = reads.select(key, "seq", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id")).unionByName(created.select(key, "seq", F.lit(1).alias("kind"), F.col("id").cast("string").alias("id")))
    before = Window.partitionBy(key).orderBy("seq", "kind", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = events.withColumns({"rows": F.sum("kind").over(before), "last_id": F.last("id", ignorenulls=True).over(before)})
    return seen.where("kind = 0").select("seq", "rows", "last_id")


def _argument(name: str) -> Column:
    return F.try_variant_get(F.try_parse_json("args"), f"$.{name}", "string")


def _read_chunk(tables: dict[str, DataFrame], calls: DataFrame) -> DataFrame:
    """The chunk of an id, as {"id", "text"}."""
    wanted = calls.withColumn("id", F.coalesce(_argument("chunk_id"), F.lit("")))
    found = wanted.join(tables["chunks"].select("id", "text").dropDuplicates(["id"]).hint("merge"), "id", "left")
    return found.select("seq", F.when(F.col("text").isNotNull(), F.to_json(F.struct("id", "text"))).otherwise('{"error": "Chunk not found"}').alias("result"))


def _find_chunks(tables: dict[str, DataFrame], calls: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` chunks of the call's document that hold the query, in any case of its letters, as a list."""
    wanted = calls.select("seq", "document_id", F.lower(F.coalesce(_argument("query"), F.lit(""))).alias("query"))
    near = wanted.join(tables["chunks"].hint("merge"), "document_id").where(F.contains(F.lower("text"), "query"))
    first = near.withColumn("_r", F.row_number().over(Window.partitionBy("seq").orderBy("id"))).where(F.col("_r") <= most)
    listed = first.groupBy("seq").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "text")))).alias("result"))
    return wanted.select("seq").join(listed.hint("merge"), "seq", "left").select("seq", F.coalesce("result", F.lit("[]")).alias("result"))


def _read_created(tables: dict[str, DataFrame], calls: DataFrame) -> DataFrame:
    """How many blocks the log had created in the call's document before it, and the last of them."""
    return as_of(calls, tables["created"]).select("seq", F.to_json(F.struct("rows", "last_id")).alias("result"))


#: Reads of a recorded log: tool name -> (tables, calls [seq, document_id, args]) -> [seq, result].
REGISTRY: dict[str, Callable[[dict[str, DataFrame], DataFrame], DataFrame]] = {"read_content_db": _read_chunk, "query_vector_db": _find_chunks, "queryagentdb": _read_created}


def run_reads(calls: DataFrame, tables: dict[str, DataFrame], registry: dict[str, Callable] | None = None) -> DataFrame:
    """[seq, tool, result] of the calls [seq, document_id, tool, args] whose tool the registry holds; other calls have no row.

    ``tables`` has ``chunks`` [id, document_id, text] and ``created`` [seq, document_id, id], the rows that the same log
    creates. A tool is added by its name and a function of DataFrames.
    """
    named = calls.withColumn("tool", registered(F.col("tool")) if registry is None else F.lower("tool"))
    results = [run(tables, named.where(F.col("tool") == name)).select("seq", F.lit(name).alias("tool"), "result") for name, run in (registry or REGISTRY).items()]
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found


_LOADED: dict[str, Callable[[str], str]] = {}


def _loaded(name: str, load: Callable[[], Callable[[str], str]]) -> Callable[[str], str]:
    """A hook's function, loaded once in a Python worker."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def with_hook(df: DataFrame, prompt: str, output: str, name: str, load: Callable[[], Callable[[str], str]]) -> DataFrame:
    """``df`` with ``output``: what a function answers to each ``prompt``, in place of a model.

    ``load`` makes the function, once in each Python worker (``name`` tells hooks apart); texts pass in
    Arrow batches, so a task holds one batch at a time. A null prompt, and an answer that fails, are null.
    """
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = _loaded(name, load)

        def one(text: str | None) -> str | None:
            try:
                return None if text is None else answer(text)
            except Exception:  # noqa: BLE001  the call counts as failed, as a model's error does
                return None

        for batch in batches:
            yield batch.map(one)

    return df.withColumn(output, answers(F.col(prompt)))

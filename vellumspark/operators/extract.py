"""Structure extraction: text, Markdown and HTML to sections, blocks and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.text import trimmed, word_count
from vellumspark.session import ship, spread


def _joined(text: str, delimiter: str, order: str) -> Column:
    """Texts of a group joined in order."""
    return F.expr(f"listagg({text}, '{delimiter}') WITHIN GROUP (ORDER BY {order})")


def text_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """[document_id, pos, raw, line] of every line; ``line`` is trimmed."""
    split = docs.select("document_id", F.posexplode(F.split(text_col, "\n")).alias("pos", "raw"))
    return split.withColumn("raw", F.regexp_replace("raw", "\r$", "")).withColumn("line", trimmed(F.col("raw")))


def text_node(text: Column) -> Column:
    """JSON of a plain text node of the block model."""
    none = F.lit(None).cast("boolean")
    return F.to_json(
        F.struct(F.lit("text").alias("type"), text.alias("text"), none.alias("bold"), none.alias("italic"), none.alias("code")), {"ignoreNullFields": "false"}
    )


def delineate(docs: DataFrame) -> DataFrame:
    """Headings, paragraphs and images of plain texts: [document_id, sort_order, block_type, level, text, src].

    Lines of known openings and numbered lines are headings; short titles are headings unless a
    paragraph is open; blank and image lines close paragraphs; other lines join into paragraphs.
    A text without blocks gets one placeholder paragraph.
    """
    line = F.col("line")
    known = line.rlike(r"^(?:Abstract|References|Chapter|Section|Table |Figure |(?:I|II|III|IV|V|VI|VII|VIII)\. )") | line.rlike(r"^[0-9]+\. ")
    short = (F.octet_length(line) < 80) & line.rlike(r"^\p{Lu}") & ~line.rlike(r"[.,;:]$")
    kind = F.when(line == "", "B").when(line.startswith("[Image:"), "I").when(known, "H").when(short, "S").otherwise("T")
    order = Window.partitionBy("document_id").orderBy("pos")
    earlier = F.last(F.when(F.col("k") != "S", F.col("k")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    lines = text_lines(docs).withColumn("k", kind).withColumn("before", earlier)
    role = F.when(F.col("k") == "S", F.when(F.col("before") == "T", "T").otherwise("H")).otherwise(F.col("k"))
    lines = lines.withColumn("role", role)
    fresh = F.when(F.col("role").isin("H", "I") | ((F.col("role") == "T") & (F.lag("role").over(order).eqNullSafe("T") == F.lit(False))), 1).otherwise(0)
    lines = lines.withColumn("block", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("role <> 'B'")
    grouped = lines.groupBy("document_id", "block").agg(F.first("role").alias("role"), _joined("line", " ", "pos").alias("text"))
    uri = F.regexp_extract("text", r"local-asset://[^\]]*", 0)
    found = grouped.select(
        "document_id",
        (F.col("block") - 1).cast("int").alias("sort_order"),
        F.when(F.col("role") == "H", "heading").when(F.col("role") == "I", "image").otherwise("paragraph").alias("block_type"),
        F.when(F.col("role") == "H", 2).alias("level"),
        F.when(F.col("role") != "I", F.col("text")).alias("text"),
        F.when(F.col("role") == "I", F.when(uri == "", "local-asset://default.png").otherwise(uri)).alias("src"),
    )
    empty = docs.where(trimmed(F.coalesce("text", F.lit(""))) == "").select(
        "document_id", F.lit(0).alias("sort_order"), F.lit("paragraph").alias("block_type"), F.lit(None).cast("int").alias("level"),
        F.lit("Empty page content.").alias("text"), F.lit(None).cast("string").alias("src"),
    )
    return found.unionByName(empty)


#: Characters of the texts whose lines one task sorts.
PART_CHARS = 2_000_000


def markdown_lines(docs: DataFrame) -> DataFrame:
    """Lines with their block kind, fence number, section number, heading depth and title."""
    order = Window.partitionBy("document_id").orderBy("pos")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    lines = text_lines(spread(docs, F.length("text"), PART_CHARS, "document_id")).withColumn("fence", line.startswith("```"))
    lines = lines.withColumn("fences", F.sum(F.col("fence").cast("int")).over(running))
    inside = ~F.col("fence") & (F.col("fences") % 2 == 1)
    heading = line.rlike(r"^#{1,6}(?: .*)?$")
    image = line.rlike(r"^!\[.*\]\(") & line.contains(")")
    kind = (
        F.when(F.col("fence"), F.when(F.col("fences") % 2 == 0, "code").otherwise("none"))
        .when(inside, "inside")
        .when(line == "", "none")
        .when(heading, "heading")
        .when(line.startswith(">"), "quote")
        .when(image, "image")
        .when(line.rlike(r"^[-*] "), "list")
        .otherwise("paragraph")
    )
    lines = lines.withColumn("kind", kind).withColumn("depth", F.when(F.col("kind") == "heading", F.length(F.regexp_extract(line, "^#+", 0))))
    return lines.withColumn("section", F.sum(F.col("depth").isNotNull().cast("int")).over(running)).withColumn(
        "title", F.when(F.col("kind") == "heading", trimmed(F.regexp_extract(line, "^#+(.*)$", 1)))
    )


def markdown_sections(docs: DataFrame) -> DataFrame:
    """[document_id, id, parent_id, title, depth_level, sort_order]: a default section and one per heading.

    The parent is the nearest earlier section of smaller depth; the default section has depth 1.
    """
    order = Window.partitionBy("document_id").orderBy("sort_order").rowsBetween(Window.unboundedPreceding, -1)
    heads = markdown_lines(docs).where("kind = 'heading'").select("document_id", "title", F.col("depth").alias("depth_level"), F.col("section").cast("int").alias("sort_order"))
    default = docs.select("document_id", F.lit("Default Section").alias("title"), F.lit(1).alias("depth_level"), F.lit(0).alias("sort_order"))
    every = default.unionByName(heads)
    above = F.greatest(*[F.when(F.lit(d) < F.col("depth_level"), F.last(F.when(F.col("depth_level") == d, F.col("sort_order")), ignorenulls=True).over(order)) for d in range(1, 7)])
    every = every.withColumn("parent", above)

    def name(number: Column) -> Column:
        return F.when(number == 0, F.concat(F.lit("sec-"), "document_id", F.lit("-default"))).when(number > 0, F.concat(F.lit("sec-md-"), "document_id", F.lit("-"), number.cast("string")))

    return every.select("document_id", name(F.col("sort_order")).alias("id"), name(F.col("parent")).alias("parent_id"), "title", "depth_level", "sort_order")


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """[document_id, id, section_id, block_type, content, sort_order, semantic_tags] of Markdown texts."""
    lines = markdown_lines(docs)
    # a block's lines as one group: the lines inside a fence with the one that closes it, any other line by itself; no join, so no shuffle
    inside = F.col("kind") == "inside"
    unit = F.when(inside, -F.col("fences")).when(F.col("kind") == "code", 1 - F.col("fences")).otherwise(F.col("pos"))
    block = F.when(~inside, F.struct("pos", "kind", "line", "depth", "section", "title"))
    groups = lines.where("kind <> 'none'").withColumns({"unit": unit, "inner": F.when(inside, F.col("raw")), "block": block}).groupBy("document_id", "unit")
    kept = groups.agg(_joined("inner", "\\n", "pos").alias("code"), F.first("block", ignorenulls=True).alias("block")).where("block IS NOT NULL").select("document_id", "code", "block.*")
    order = Window.partitionBy("document_id").orderBy("pos")
    images = order.rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("sort_order", F.row_number().over(order) - 1).withColumn("image", F.sum((F.col("kind") == "image").cast("int")).over(images))
    line = F.col("line")
    source = F.regexp_extract(line, r"^[^(]*\(([^)]*)\)", 1)
    uri = F.concat(F.lit("local-asset://"), F.sha2(source, 256), F.lit("_img-md-"), F.col("image").cast("string"), F.lit(".png"))
    alt = F.regexp_extract(line, r"^!\[([^\]]*)\]", 1)
    none = F.lit(None).cast("string")

    def wrapped(head: Column, text: Column, tail: str) -> Column:
        return F.concat(head, text_node(text), F.lit(tail))

    raw = F.to_json(F.struct(F.lit("code_block").alias("type"), trimmed(F.coalesce("code", F.lit(""))).alias("code"), none.alias("language")), {"ignoreNullFields": "false"})
    content = (
        F.when(F.col("kind") == "heading", wrapped(F.concat(F.lit('{"type":"heading","level":'), F.col("depth").cast("string"), F.lit(',"children":[')), F.col("title"), "]}"))
        .when(F.col("kind") == "quote", wrapped(F.lit('{"type":"quote","children":['), trimmed(F.regexp_replace(line, "^>", "")), "]}"))
        .when(F.col("kind") == "list", wrapped(F.lit('{"type":"list","ordered":false,"items":[{"children":['), trimmed(F.expr("substring(line, 3)")), "]}]}"))
        .when(F.col("kind") == "image", F.to_json(F.struct(F.lit("image").alias("type"), uri.alias("src"), alt.alias("alt"), none.alias("caption")), {"ignoreNullFields": "false"}))
        .when(F.col("kind") == "code", raw)
        .otherwise(wrapped(F.lit('{"type":"paragraph","children":['), line, "]}"))
    )
    return kept.select(
        "document_id",
        F.concat(F.lit("block-md-"), "document_id", F.lit("-"), F.col("sort_order").cast("string")).alias("id"),
        F.when(F.col("section") == 0, F.concat(F.lit("sec-"), "document_id", F.lit("-default"))).otherwise(F.concat(F.lit("sec-md-"), "document_id", F.lit("-"), F.col("section").cast("string"))).alias("section_id"),
        F.when(F.col("kind") == "list", "paragraph").otherwise(F.col("kind")).alias("block_type"),
        content.alias("content"),
        F.col("sort_order").cast("int").alias("sort_order"),
        F.when(F.col("kind") == "paragraph", F.array().cast("array<string>")).otherwise(F.array("kind")).alias("semantic_tags"),
    )


def image_refs(docs: DataFrame) -> DataFrame:
    """[document_id, image_id, sha256_hash, local_uri, alt] of Markdown image lines."""
    order = Window.partitionBy("document_id").orderBy("pos")
    found = markdown_lines(docs).where("kind = 'image'").withColumn("image_id", F.concat(F.lit("img-md-"), F.row_number().over(order).cast("string")))
    digest = F.sha2(F.regexp_extract("line", r"^[^(]*\(([^)]*)\)", 1), 256)
    uri = F.concat(F.lit("local-asset://"), digest, F.lit("_"), F.col("image_id"), F.lit(".png"))
    return found.select("document_id", "image_id", digest.alias("sha256_hash"), uri.alias("local_uri"), F.regexp_extract("line", r"^!\[([^\]]*)\]", 1).alias("alt"))


_CLOSED = "|".join(rf"<(?i:{name})(?:>|\s[^>]*>).*?</{name}>" for name in [*[f"h{d}" for d in range(10)], "p", "table", "blockquote"])


def html_parts(pages: DataFrame) -> DataFrame:
    """[document_id, pos, part, kind, depth, text] of HTML: closed elements (empty ones too), images and loose text."""
    from vellumspark.functions.text import strip_elements

    split = pages.select("document_id", F.posexplode(F.regexp_extract_all(strip_elements(F.col("html")), F.lit(rf"(?s){_CLOSED}|<[^>]*>|[^<]+(?=<)"), 0)).alias("pos", "part"))
    name = F.lower(F.regexp_extract("part", r"(?i)^<(h[0-9]|p|table|blockquote|img)(?:[\s>/])", 1))
    inner = trimmed(F.regexp_extract("part", r"(?s)^<[^>]*>(.*)</[a-z0-9]+>$", 1))
    closed = F.col("part").rlike(r"(?s)^<(?i:h[0-9]|p|table|blockquote)(?:>|\s).*</(?:h[0-9]|p|table|blockquote)>$")
    kind = (
        F.when(closed & name.rlike("^h"), "heading")
        .when(closed & (name == "p"), "paragraph")
        .when(closed & (name == "table"), "table")
        .when(closed & (name == "blockquote"), "quote")
        .when(name == "img", "image")
        .when(~F.col("part").startswith("<") & (trimmed(F.col("part")) != ""), "loose")
    )
    text = F.when(F.col("kind") == "loose", trimmed(F.col("part"))).when(F.col("kind") != "image", inner)
    parts = split.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("text", text)
    return parts.withColumn("depth", F.when(F.col("kind") == "heading", F.substring("part", 3, 1).cast("int")))


def _attribute(part: Column, name: str) -> Column:
    """Value of a tag's attribute, quoted or bare; empty where there is none."""
    found = F.regexp_extract(part, rf"(?i)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    return F.regexp_replace(found, r"^[\"']|[\"']$", "")


def _table_content(inner: Column) -> Column:
    """JSON of a table node; rows without cells are left out, and without any row one cell holds the raw text."""
    rows = F.regexp_extract_all(inner, F.lit(r"(?is)<tr(?:>|\s[^>]*>)(.*?)</tr>"), 1)

    def cell(raw: Column) -> Column:
        body = trimmed(F.regexp_extract(raw, r"(?s)^<[^>]*>(.*)</[A-Za-z]+>$", 1))
        return F.concat(F.lit('{"children":['), text_node(body), F.lit('],"is_header":'), F.when(F.lower(raw).startswith("<th"), "true").otherwise("null"), F.lit("}"))

    def row(raw: Column) -> Column:
        cells = F.transform(F.regexp_extract_all(raw, F.lit(r"(?is)<td(?:>|\s[^>]*>).*?</td>|<th(?:>|\s[^>]*>).*?</th>"), 0), cell)
        return F.when(F.size(cells) > 0, F.concat(F.lit('{"cells":['), F.array_join(cells, ","), F.lit("]}")))

    whole = F.concat(F.lit('{"cells":[{"children":['), text_node(inner), F.lit('],"is_header":null}]}'))
    found = F.filter(F.transform(rows, row), lambda r: r.isNotNull())
    return F.concat(F.lit('{"type":"table","rows":['), F.when(F.size(found) > 0, F.array_join(found, ",")).otherwise(whole), F.lit("]}"))


def _html_numbered(pages: DataFrame) -> DataFrame:
    """Parts with their number, section and image number."""
    order = Window.partitionBy("document_id").orderBy("pos")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    parts = html_parts(pages).withColumn("section", F.sum(F.col("depth").isNotNull().cast("int")).over(running).cast("int"))
    parts = parts.withColumn("image", F.sum((F.col("kind") == "image").cast("int")).over(running)).withColumn("sort_order", F.row_number().over(order) - 1)
    digest = F.sha2(_attribute(F.col("part"), "src"), 256)
    image_id = F.concat(F.lit("img-html-"), F.col("image").cast("string"))
    return parts.withColumns({"image_id": image_id, "sha256_hash": digest, "local_uri": F.concat(F.lit("local-asset://"), digest, F.lit("_"), image_id, F.lit(".png")), "alt": _attribute(F.col("part"), "alt")})


def _html_section_id(number: Column) -> Column:
    return F.when(number == 0, F.concat(F.lit("sec-"), "document_id", F.lit("-default"))).otherwise(F.concat(F.lit("sec-html-"), "document_id", F.lit("-"), number.cast("string")))


def html_sections(pages: DataFrame) -> DataFrame:
    """[document_id, id, parent_id, title, depth_level, sort_order]: a default section and one per heading, also an empty one; none has a parent."""
    heads = _html_numbered(pages).where("kind = 'heading'").select("document_id", F.col("text").alias("title"), F.col("depth").alias("depth_level"), F.col("section").alias("sort_order"))
    every = pages.select("document_id", F.lit("Default Section").alias("title"), F.lit(1).alias("depth_level"), F.lit(0).alias("sort_order")).unionByName(heads)
    return every.select("document_id", _html_section_id(F.col("sort_order")).alias("id"), F.lit(None).cast("string").alias("parent_id"), "title", "depth_level", "sort_order")


def html_structure(pages: DataFrame) -> DataFrame:
    """[document_id, id, section_id, block_type, content, sort_order, semantic_tags] of HTML pages."""
    parts = _html_numbered(pages)
    leaf = F.concat(F.lit('"children":['), text_node(F.col("text")), F.lit("]}"))
    image = F.to_json(F.struct(F.lit("image").alias("type"), F.col("local_uri").alias("src"), F.nullif("alt", F.lit("")).alias("alt"), F.lit(None).cast("string").alias("caption")), {"ignoreNullFields": "false"})
    content = (
        F.when(F.col("kind") == "heading", F.concat(F.lit('{"type":"heading","level":'), F.col("depth").cast("string"), F.lit(","), leaf))
        .when(F.col("kind") == "quote", F.concat(F.lit('{"type":"quote",'), leaf))
        .when(F.col("kind") == "table", _table_content(F.col("text")))
        .when(F.col("kind") == "image", image)
        .otherwise(F.concat(F.lit('{"type":"paragraph",'), leaf))
    )
    block_type = F.when(F.col("kind") == "loose", "paragraph").otherwise(F.col("kind"))
    return parts.select(
        "document_id",
        F.concat(F.lit("block-html-"), "document_id", F.lit("-"), F.col("sort_order").cast("string")).alias("id"),
        _html_section_id(F.col("section")).alias("section_id"),
        block_type.alias("block_type"),
        content.alias("content"),
        "sort_order",
        F.when(block_type == "paragraph", F.array().cast("array<string>")).otherwise(F.array(block_type)).alias("semantic_tags"),
    )


def html_images(pages: DataFrame) -> DataFrame:
    """[document_id, image_id, sha256_hash, local_uri, alt] of ``<img>`` tags; the hash is that of the source's name."""
    return _html_numbered(pages).where("kind = 'image'").select("document_id", "image_id", "sha256_hash", "local_uri", "alt")


def html_blocks(pages: DataFrame) -> DataFrame:
    """[document_id, section, sort_order, block_type, depth, text] of HTML pages; section 0 precedes any heading."""
    order = Window.partitionBy("document_id").orderBy("pos")
    parts = html_parts(pages)
    parts = parts.withColumn("section", F.sum(F.col("depth").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.select(
        "document_id",
        F.col("section").cast("int").alias("section"),
        (F.row_number().over(order) - 1).alias("sort_order"),
        F.when(F.col("kind") == "loose", "paragraph").otherwise(F.col("kind")).alias("block_type"),
        "depth",
        "text",
    )


def html_cells(tables: DataFrame) -> DataFrame:
    """[block_id, row, col, is_header, text] of HTML tables; without rows one cell holds the raw content."""
    rows = F.regexp_extract_all("html", F.lit(r"(?s)<tr(?:>|\s[^>]*>)(.*?)</tr>"), 1)
    some = tables.withColumn("rows", rows)
    row = some.select("block_id", F.posexplode("rows").alias("row", "body"))
    cell = row.select("block_id", "row", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<t[dh](?:>|\s[^>]*>).*?</t[dh]>"), 0)).alias("col", "cell"))
    full = cell.select("block_id", "row", "col", F.col("cell").startswith("<th").alias("is_header"), trimmed(F.regexp_extract("cell", r"(?s)^<[^>]*>(.*)</t[dh]>$", 1)).alias("text"))
    none = some.where(F.size("rows") == 0).select("block_id", F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(False).alias("is_header"), trimmed(F.col("html")).alias("text"))
    return full.unionByName(none)


def chunk_starts(words: np.ndarray, sizes: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of the units that open a chunk, text by text, for the units of many texts in one array.

    ``words`` are the units' word counts; -1 - n is a unit of n words that always opens one. Every unit
    points at the one that would open the next chunk if it opened one itself: the first whose
    running count exceeds its own by more than ``most``, found in the prefix sums. The pointers from
    the first units are then followed by doubling: each round takes all chunks found so far twice as
    far, so it needs as many rounds as the longest text's number of chunks has bits.
    """
    n = len(words)
    opens, count = words < 0, np.where(words < 0, -1 - words, words).astype(np.int64)
    through = np.cumsum(count)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(n)
    follow = np.maximum(np.searchsorted(through, through - count + most, side="right"), at + 1)
    forced = np.minimum.accumulate(np.append(np.where(opens, at, n), n)[::-1])[::-1][1:]
    follow = np.minimum(np.minimum(follow, forced), ends)
    jump = np.append(np.where(follow == ends, n, follow), n)
    begins = np.cumsum(sizes) - sizes
    found = np.zeros(n + 1, bool)
    found[begins[sizes > 0]] = True
    while (jump < n).any():
        found[jump[found]] = True
        jump = jump[jump]
    starts = np.flatnonzero(found[:n])
    bounds = np.searchsorted(starts, np.append(begins, n))
    return [starts[a:b] - first for a, b, first in zip(bounds[:-1], bounds[1:], begins, strict=True)]


def chunk(docs: DataFrame, max_words: int = 150) -> DataFrame:
    """Greedy chunks of paragraphs: [document_id, chunk_index, seq, text, word_count].

    Paragraphs are packed up to ``max_words``; a larger one is cut at sentence ends, and its
    last group of sentences opens the next chunk. A single longer sentence stays whole.

    Texts stay in their rows, and nothing is shuffled: word counts go to :func:`chunk_starts` in
    Arrow batches, and the chunks are slices of the row's units.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def starts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch], np.int64)
            flat = np.concatenate([np.zeros(0, np.int64), *batch.to_list()]).astype(np.int64)
            yield pd.Series([x.tolist() for x in chunk_starts(flat, sizes, max_words)])

    def unit(text: Column, words: Column, joint: Column, opens: Column) -> Column:
        return F.struct(text.alias("text"), words.alias("words"), joint.alias("joint"), opens.alias("opens"))

    def units(paragraph: Column) -> Column:
        words = word_count(paragraph)
        parts = F.transform(F.split(paragraph, r"\. "), lambda x, i: unit(x, word_count(x), F.when(i == 0, "\n\n").otherwise(". "), i == 0))
        return F.when(words > max_words, parts).otherwise(F.array(unit(paragraph, words, F.lit("\n\n"), F.lit(False))))

    split = docs.select("document_id", F.flatten(F.transform(F.split(F.coalesce("text", F.lit("")), "\n\n"), units)).alias("units"))
    marked = split.withColumn("starts", starts(F.transform("units", lambda u: F.when(u["opens"], -1 - u["words"]).otherwise(u["words"]))))
    ends = F.concat(F.expr("slice(starts, 2, size(starts))"), F.array(F.size("units")))
    spans = marked.select("document_id", "units", F.posexplode(F.arrays_zip(F.col("starts"), ends.alias("ends"))).alias("seq", "span"))
    own = spans.select("document_id", "seq", F.slice("units", F.col("span.starts") + 1, F.col("span.ends") - F.col("span.starts")).alias("own"))
    text = F.array_join(F.transform("own", lambda u, i: F.when(i == 0, u["text"]).otherwise(F.concat(u["joint"], u["text"]))), "")
    return own.select("document_id", F.lit(0).alias("chunk_index"), "seq", text.alias("text"), F.aggregate("own", F.lit(0), lambda n, u: n + u["words"]).alias("word_count"))


def overlap_context(pages: DataFrame, pieces: int = 4) -> DataFrame:
    """Pages with the last sentences of the page before: [document_id, page, overlap_context]."""
    before = F.lag("text").over(Window.partitionBy("document_id").orderBy("page"))
    parts = F.transform(F.split("before", r"\."), lambda x: trimmed(x))
    tail = F.slice(parts, F.greatest(F.size(parts) - (pieces - 1), F.lit(1)), pieces)
    return pages.withColumn("before", before).select("document_id", "page", F.coalesce(F.array_join(tail, ". "), F.lit("")).alias("overlap_context"))


def to_sections(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, blocks with section_id): every heading block opens a section; earlier blocks are in section 0."""
    order = Window.partitionBy("document_id").orderBy("sort_order").rowsBetween(Window.unboundedPreceding, 0)
    numbered = blocks.withColumn("_n", F.sum((F.col("block_type") == "heading").cast("int")).over(order))
    name = F.concat(F.lit("sec-"), F.col("document_id"), F.lit("-"), F.col("_n").cast("string"))
    heads = numbered.where("block_type = 'heading'").select("document_id", name.alias("id"), F.col("text").alias("title"), F.col("_n").cast("int").alias("sort_order"))
    loose = numbered.where("_n = 0").select("document_id").distinct().select("document_id", F.concat(F.lit("sec-"), "document_id", F.lit("-0")).alias("id"), F.lit("Default Section").alias("title"), F.lit(0).alias("sort_order"))
    return heads.unionByName(loose), numbered.withColumn("section_id", name).drop("_n")

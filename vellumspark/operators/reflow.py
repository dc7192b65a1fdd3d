"""Block heights, pagination, highlights, and reading order of positioned tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.text import truncate_tokens
from vellumspark.operators.groups import fold_groups
from vellumspark.operators.notes import occurrences
from vellumspark.session import ship


def static_height(block_type: Column, content: Column) -> Column:
    """Estimated height of a block from its type and markup."""
    low = F.lower(content)
    plain = F.length(F.trim(F.regexp_replace(content, "<[^>]*>", "")))
    lines = F.size(F.split(content, "\n|<br>|<BR>"))
    rows = F.size(F.regexp_extract_all(content, F.lit("(?i)<tr>"), 0))
    return (
        F.when((block_type == "heading") | low.rlike("^<h[123]"), 60)
        .when((block_type == "code") | low.contains("<code>") | low.contains("<pre>"), F.greatest(F.lit(1), lines) * 20 + 32)
        .when((block_type == "table") | low.contains("<table>"), F.greatest(F.lit(1), rows) * 40 + 36)
        .when((block_type == "image") | low.contains("<img") | content.contains("local-asset://"), 300)
        .when((block_type == "math") | low.contains("katex") | low.contains('class="math"'), 80)
        .when(plain == 0, 40)
        .otherwise(F.ceil(plain / 80).cast("int") * 24 + 20)
        .cast("double")
    )


def dynamic_height(block_type: Column, text: Column, width: float, height: float, font: float, line: float, rows: Column | None = None) -> Column:
    """Height of a block in a viewport and typography; ``rows`` counts code lines or table rows."""
    rows = F.greatest(F.lit(1), rows) if rows is not None else F.lit(1)
    per_line = max(15, int(max(100.0, width - 32) // (font * 0.55)))
    chars = F.length(F.coalesce(text, F.lit("")))
    return (
        F.when(block_type == "heading", font * 1.3 * 1.4 + 24)
        .when(block_type == "code", rows * (font * 1.3) + 32)
        .when(block_type == "table", rows * (font * 1.8) + 36)
        .when(block_type == "image", min(300.0, height * 0.4))
        .when(block_type == "math", font * 3 + 20)
        .when(chars == 0, font * 1.5 + 16)
        .otherwise(F.ceil(chars / per_line) * line + 16)
        .cast("double")
    )


def _pages(blocks: list[tuple], limit: float) -> list[tuple]:
    """Segments of one section's blocks (document, section, number, block, type, text, height), page by page."""
    rows, page, used = [], 0, 0.0
    for _, _, _, block, kind, text, height in blocks:
        text = text or ""
        n = len(text)
        if n == 0:
            if kind not in ("image", "table"):
                continue
            if used + height > limit and used > 0:
                page, used = page + 1, 0.0
            rows.append((page, block, 0, 0, False))
            if height > limit:
                page, used = page + 1, 0.0
            else:
                used = used + height
            continue
        at = 0
        while at < n:
            left = height * (n - at) / n
            if used + left <= limit:
                rows.append((page, block, at, n, at > 0))
                used, at = used + left, n
            elif used > 0:
                page, used = page + 1, 0.0
            else:
                cut = at + max(50, int(n * (limit / height)))
                if cut >= n:
                    cut = n
                else:
                    before, after = text.rfind(" ", 0, cut + 1), text.find(" ", cut)
                    if before > at and cut - before < 30:
                        cut = before
                    elif after != -1 and after - cut < 30:
                        cut = after
                rows.append((page, block, at, cut, True))
                page, at = page + 1, cut
    return [(*blocks[0][:2], *r) for r in rows]


def paginate(blocks: DataFrame, viewport_height: float) -> DataFrame:
    """[document_id, section_id, page, block_id, start, end, is_partial] of blocks with a height.

    A greedy fold over each section; sections are bounded by nature and run in parallel.
    """
    columns = ["document_id", "section_id", "sort_order", "block_id", "block_type", "text", "height"]
    schema = "document_id string, section_id string, page int, block_id string, start int, end int, is_partial boolean"
    return fold_groups(blocks.select(*columns), columns[:2], columns[2:4], partial(_pages, limit=max(200.0, viewport_height - 100)), schema)


def slice_block(text: Column, start: Column, end: Column) -> Column:
    """JSON paragraph of the text between two offsets."""
    part = F.substr(text, start + 1, end - start)
    return F.to_json(F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), part.alias("text"))).alias("children")))


def annotation_offset(anchor_json: Column, text: Column, highlighted: Column) -> Column:
    """Offset from the anchor, else of the first occurrence of the highlighted text, else null."""
    at = F.instr(text, highlighted) - 1
    return F.coalesce(F.get_json_object(anchor_json, "$.offset").cast("int"), F.when((highlighted != "") & (at >= 0), at))


def clip_annotations(segments: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations clipped and shifted to the segments they overlap; those without an offset pass whole."""
    joined = segments.join(annotations.hint("merge"), "block_id")
    a, b = F.col("offset"), F.col("offset") + F.length("highlighted_text")
    over = F.col("offset").isNull() | ((a < F.col("end")) & (b > F.col("start")))
    first, last = F.greatest(a, F.col("start")), F.least(b, F.col("end"))
    text = F.when(F.col("offset").isNull(), F.col("highlighted_text")).otherwise(F.substr("highlighted_text", first - a + 1, last - first))
    return joined.where(over).select("block_id", "page", "start", "annotation_id", (first - F.col("start")).alias("shifted"), text.alias("clipped"))


def highlight_segments(blocks: DataFrame, annotations: DataFrame) -> DataFrame:
    """[block_id, n, text, is_highlighted, color, annotation_id]: texts cut at their highlights.

    Overlapping matches merge into the first one; the gaps are plain segments.
    """
    hits = blocks.select("block_id", "text").join(annotations.select("block_id", "annotation_id", "highlighted_text", "color").hint("merge"), "block_id")
    hits = hits.where(F.col("highlighted_text") != "").withColumn("s", F.explode(occurrences(F.col("text"), F.col("highlighted_text"))))
    hits = hits.select("block_id", "text", "annotation_id", "color", "s", (F.col("s") + F.length("highlighted_text")).alias("e"))
    order = Window.partitionBy("block_id").orderBy("s", "annotation_id")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("_reach", reach).withColumn("_i", F.sum(F.when(F.col("s") < F.col("_reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = hits.groupBy("block_id", "_i").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.first("text").alias("text"), F.min_by("color", F.struct("s", "annotation_id")).alias("color"),
        F.min_by("annotation_id", F.struct("s", "annotation_id")).alias("annotation_id"),
    )
    by = Window.partitionBy("block_id").orderBy("s")
    runs = runs.withColumn("before", F.coalesce(F.lag("e").over(by), F.lit(0))).withColumn("is_last", F.lead("s").over(by).isNull())

    def part(a: Column, b: Column, lit: bool) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(a.alias("at"), F.substr("text", a + 1, b - a).alias("text"), F.lit(lit).alias("is_highlighted"), (F.col("color") if lit else none).alias("color"), (F.col("annotation_id").cast("string") if lit else none).alias("annotation_id"))

    pieces = F.array(part(F.col("before"), F.col("s"), False), part(F.col("s"), F.col("e"), True), F.when(F.col("is_last"), part(F.col("e"), F.length("text"), False)))
    cut = runs.select("block_id", F.explode(F.filter(pieces, lambda p: p.isNotNull() & (F.length(p["text"]) > 0))).alias("p")).select("block_id", "p.*")
    none = F.lit(None).cast("string")
    plain = blocks.select("block_id", "text").join(runs.select("block_id").distinct().hint("merge"), "block_id", "left_anti").select("block_id", F.lit(0).alias("at"), "text", F.lit(False).alias("is_highlighted"), none.alias("color"), none.alias("annotation_id"))
    every = cut.unionByName(plain)
    return every.select("block_id", (F.row_number().over(Window.partitionBy("block_id").orderBy("at")) - 1).alias("n"), "text", "is_highlighted", "color", "annotation_id")


def scroll_action(events: DataFrame) -> DataFrame:
    """Events with ``action`` (prev, next or null) and ``target`` section."""
    fits = (F.col("content") == 0) | (F.col("layout") == 0) | (F.col("content") <= F.col("layout"))
    action = (
        F.when(fits, None)
        .when((F.col("offset") < -50) & F.col("prev_id").isNotNull(), "prev")
        .when((F.col("offset") + F.col("layout") >= F.col("content") - 100) & F.col("next_id").isNotNull(), "next")
    )
    return events.withColumn("action", action).withColumn("target", F.when(F.col("action") == "prev", F.col("prev_id")).when(F.col("action") == "next", F.col("next_id")))


#: Fields of a token of a page.
TOKEN = ("left", "bottom", "right", "top", "font_size", "text")
_TOKEN = "left double, bottom double, right double, top double, font_size double, text string"
#: Pages that a task works on at once.
PAGES = 1024
#: Bytes that separate tokens.
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))

#: A step of a task: from one batch of pages to the next. Steps that follow each other in one task cost no way through the JVM.
Step = Callable[[pa.RecordBatch], pa.RecordBatch]


def _in_tasks(pages: DataFrame, steps: tuple[Step, ...], more: str) -> DataFrame:
    """[document_id, page, ``more``] of pages that pass through all steps of a task, some at a time."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAGES):
                batch = whole.slice(at, PAGES)
                for step in steps:
                    batch = step(batch)
                yield batch

    kinds = dict(pages.dtypes)
    return pages.mapInArrow(run, f"document_id {kinds['document_id']}, page {kinds['page']}, {more}")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a column of texts, the first offset being 0."""
    texts = texts.cast(pa.string())
    if not len(texts):
        return np.zeros(1, np.int32), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return at - at[0], np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)


def joined_texts(at: np.ndarray, data: np.ndarray) -> pa.Array:
    """Texts from one offset of the bytes to the next."""
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _lists(lists: pa.ListArray) -> tuple[pa.StructArray, np.ndarray]:
    """What the lists of a column hold, and the place where each starts; a null list holds nothing."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.append(0, np.cumsum(sizes))


def _doubles(c: pa.Array) -> np.ndarray:
    """Numbers of a column, null as NaN."""
    return c.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _pages_of(batch: pa.RecordBatch, at: np.ndarray) -> list[pa.Array]:
    """document_id and page of every row of the pages' lists."""
    own = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(at)))
    return [batch.column("document_id").take(own), batch.column("page").take(own)]


def tokens_of(batch: pa.RecordBatch, max_tokens: int = 1000) -> pa.RecordBatch:
    """The step of :func:`page_tokens`."""
    glyphs, page_at = _lists(batch.column("glyphs"))
    glyph = glyphs.field("glyph").cast(pa.string())
    offsets, data = text_bytes(glyph)
    size = np.diff(offsets)
    white = np.append(_BLANK[data], True)[offsets[:-1]]
    blank = (size == 0) | white & (size == 1) | glyph.is_null().to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(white & (size > 1)):
        blank[i] = not glyph[int(i)].as_py().strip(" \t\n\x0b\f\r")
    # a token starts at a glyph behind white space or at a page's start
    begins = np.append(True, blank[:-1])[: len(blank)]
    begins[page_at[:-1][page_at[:-1] < len(blank)]] = True
    own = np.flatnonzero(~blank)
    first = np.flatnonzero(begins[own])
    many = np.diff(np.append(first, len(own)))
    page = np.searchsorted(page_at, own[first], side="right") - 1
    held = np.bincount(page, minlength=batch.num_rows)
    if len(held) and held.max() > max_tokens:
        stays = np.arange(len(first)) - (np.cumsum(held) - held)[page] < max_tokens
        own, many = own[np.repeat(stays, many)], many[stays]
        first, held = np.cumsum(many) - many, np.minimum(held, max_tokens)

    def edge(name: str, least: bool) -> pa.Array:
        values = glyphs.field(name)
        pick = np.fmin if least else np.fmax if values.null_count else np.maximum
        found = pick.reduceat(_doubles(values)[own], first) if len(first) else np.zeros(0)
        return pa.array(found, from_pandas=bool(values.null_count))

    kept, data = text_bytes(glyph.take(pa.array(own)))
    fields = [edge("left", True), edge("bottom", True), edge("right", False), edge("top", False), glyphs.field("font_size").cast(pa.float64()).take(pa.array(own[first + many - 1])), joined_texts(np.append(kept[first], kept[-1]), data)]
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), pa.StructArray.from_arrays(fields, names=list(TOKEN)))
    return pa.RecordBatch.from_arrays([batch.column("document_id"), batch.column("page"), lists], names=["document_id", "page", "tokens"])


def _rows_of_tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
    tokens, at = _lists(batch.column("tokens"))
    number = np.arange(len(tokens)) - np.repeat(at[:-1], np.diff(at))
    return pa.RecordBatch.from_arrays([*_pages_of(batch, at), pa.array(number, pa.int32()), *[tokens.field(c) for c in TOKEN]], names=["document_id", "page", "token_no", *TOKEN])


def page_tokens(pages: DataFrame, max_tokens: int = 1000) -> DataFrame:
    """[document_id, page, tokens] of pages [document_id, page, glyphs]: the runs of glyphs between white space.

    ``glyphs`` is an array of (glyph, left, bottom, right, top, font_size) in order. A token's box is the
    union of its glyphs', its font size that of the last one. Pages are bounded, so a page is a
    row from its glyphs to its text, and nothing is shuffled; the first ``max_tokens`` tokens stay.
    """
    return _in_tasks(pages.select("document_id", "page", "glyphs"), (partial(tokens_of, max_tokens=max_tokens),), f"tokens array<struct<{_TOKEN.replace(' ', ':').replace(',:', ', ')}>>")


def page_token_rows(pages: DataFrame, before: tuple[Step, ...] = ()) -> DataFrame:
    """Rows of :func:`page_tokens` as :func:`token_rows` has them; the steps ``before`` make the pages' glyphs in the same task."""
    return _in_tasks(pages, (*before, tokens_of, _rows_of_tokens), f"token_no int, {_TOKEN}")


def token_rows(pages: DataFrame) -> DataFrame:
    """[document_id, page, token_no, left, bottom, right, top, font_size, text] of pages with tokens."""
    # an outer explode, as for others Spark would compute the array a second time to filter on it
    return pages.select("document_id", "page", F.posexplode_outer("tokens").alias("token_no", "t")).where("t IS NOT NULL").select("document_id", "page", "token_no", *[F.col("t")[c].alias(c) for c in TOKEN])


def glyphs_to_tokens(glyphs: DataFrame) -> DataFrame:
    """Runs of glyphs between white space: box is the union, font size the last glyph's."""
    fields = F.struct("idx", "glyph", "left", "bottom", "right", "top", "font_size")
    pages = glyphs.where("glyph IS NOT NULL").groupBy("document_id", "page").agg(F.array_sort(F.collect_list(fields)).alias("glyphs"))
    return token_rows(page_tokens(pages, 2**31 - 1))


def cap_pages(tokens: DataFrame, max_tokens: int = 1000) -> DataFrame:
    """The first ``max_tokens`` tokens of every page."""
    order = Window.partitionBy("document_id", "page").orderBy("token_no")
    return tokens.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_tokens).drop("_r")


def cap_text(c: Column, max_bytes: int = 100_000) -> Column:
    """A page's text of at most ``max_bytes`` bytes (a multiple of 4), cut back to a whole character."""
    return truncate_tokens(c, max_bytes // 4)


def _order(boxes: list[tuple[float, float, float, float]], mid: float, tolerance: float) -> list[tuple[int, int, int]]:
    """(token, column, line) in reading order of one page's boxes (left, bottom, right, top)."""
    centres = [(b + d) / 2 for _, b, _, d in boxes]
    lines: list[list[float]] = []
    for i in sorted(range(len(boxes)), key=lambda i: -boxes[i][1]):
        a, b, c, d = boxes[i]
        for line in lines:
            if abs((line[1] + line[3]) / 2 - centres[i]) < tolerance:
                line[:] = [min(line[0], a), min(line[1], b), max(line[2], c), max(line[3], d)]
                break
        else:
            lines.append([a, b, c, d])
    left, right = sum(x[2] < mid for x in lines), sum(x[0] > mid and x[2] >= mid for x in lines)
    two = left + right > 2 * (len(lines) - left - right)
    column = [int(two and (x[0] + x[2]) / 2 >= mid) for x in boxes]
    found = []
    for c in sorted(set(column)):
        own = sorted((i for i in range(len(boxes)) if column[i] == c), key=lambda i: -centres[i])
        rows: list[list[int]] = []
        for i in own:
            if rows and abs(centres[rows[-1][0]] - centres[i]) < tolerance:
                rows[-1].append(i)
            else:
                rows.append([i])
        for n, row in enumerate(rows):
            found.extend((i, c, n) for i in sorted(row, key=lambda i: boxes[i][0]))
    return found


def _turns(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups from the largest, and how many of them have a k-th member, for all k from 0."""
    by = np.argsort(-size, kind="stable")
    return by, np.searchsorted(-size[by], -np.arange(size.max(initial=0)))


def _two_columns(at: np.ndarray, boxes: list[np.ndarray], mid: float, tolerance: float) -> np.ndarray:
    """For many pages at once, whether most lines of a page keep to one side; tokens come down from the highest bottom."""
    by, turns = _turns(np.diff(at))
    start, pages, most = at[:-1][by], np.arange(len(by)), 16
    # of a page's lines: left, bottom, right, top and centre; what is no line yet is hit by no token
    lines = [np.full((len(by), most), fill) for fill in (np.inf, np.inf, -np.inf, -np.inf, np.inf)]
    count = np.zeros(len(by), np.int64)
    for k, n in enumerate(turns):
        a, b, c, d = (side[start[:n] + k] for side in boxes)
        hits = np.abs(lines[4][:n] - ((b + d) / 2)[:, None]) < tolerance
        own = hits.argmax(axis=1)
        none = ~hits[pages[:n], own]
        own[none] = count[:n][none]
        count[:n] += none
        if count[:n].max() > most:
            lines = [np.pad(x, ((0, 0), (0, most)), constant_values=fill) for x, fill in zip(lines, (np.inf, np.inf, -np.inf, -np.inf, np.inf), strict=True)]
            most *= 2
        cell = pages[:n] * most + own
        left, bottom, right, top, centre = (x.reshape(-1) for x in lines)
        left[cell], right[cell] = np.minimum(left[cell], a), np.maximum(right[cell], c)
        bottom[cell], top[cell] = low, high = np.minimum(bottom[cell], b), np.maximum(top[cell], d)
        centre[cell] = (low + high) / 2
    aside = (((lines[2] < mid) | (lines[0] > mid)) & (np.arange(most) < count[:, None])).sum(axis=1)
    two = np.zeros(len(by), bool)
    two[by] = aside > 2 * (count - aside)
    return two


def _line_numbers(size: np.ndarray, centre: np.ndarray, tolerance: float) -> np.ndarray:
    """Number of the line of every token of columns, each with its tokens from the highest centre: a line is as near as the tolerance to its first token."""
    by, turns = _turns(size)
    start, head, row = (np.cumsum(size) - size)[by], np.full(len(size), np.nan), np.full(len(size), -1, np.int64)
    line = np.empty(len(centre), np.int64)
    for k, n in enumerate(turns):
        c = centre[start[:n] + k]
        fresh = ~(np.abs(head[:n] - c) < tolerance)
        np.copyto(head[:n], c, where=fresh)
        row[:n] += fresh
        line[start[:n] + k] = row[:n]
    return line


def _read(batch: pa.RecordBatch, mid: float, tolerance: float) -> tuple[np.ndarray, list[pa.Array]]:
    """Where each page's words start, and (token_no, column, line, rank, text) of all words in reading order.

    It does what :func:`_order` does with one page, the k-th tokens of many pages at once. Pages that lack a number are left to :func:`_order`.
    """
    tokens, at = _lists(batch.column("tokens"))
    n = len(tokens)
    page = np.repeat(np.arange(batch.num_rows), np.diff(at))
    left, bottom, right, top = boxes = [_doubles(tokens.field(c)) for c in ("left", "bottom", "right", "top")]
    down = np.lexsort((-bottom, page))
    two = _two_columns(at, [side[down] for side in boxes], mid, tolerance)
    column = (two[page] & ((left + right) / 2 >= mid)).astype(np.int64)
    strip, centre = page * 2 + column, (bottom + top) / 2
    down = np.lexsort((-centre, strip))
    line = _line_numbers(np.bincount(strip, minlength=2 * batch.num_rows), centre[down], tolerance)
    across = np.lexsort((left[down], line, strip[down]))
    place, line = down[across], line[across]
    column = column[place]
    for k in np.unique(page[np.isnan(left) | np.isnan(centre) | np.isnan(right)]):
        a, b = at[k], at[k + 1]
        found = _order(list(zip(*[side[a:b].tolist() for side in boxes], strict=True)), mid, tolerance)
        place[a:b], column[a:b], line[a:b] = np.array(found, np.int64).T + [[a], [0], [0]]
    own = pa.array(place)
    number = tokens.field("token_no").take(own) if tokens.type.get_field_index("token_no") >= 0 else pa.array(place - at[page], pa.int32())
    return at, [number.cast(pa.int32()), pa.array(column, pa.int32()), pa.array(line, pa.int32()), pa.array(np.arange(n) - at[page], pa.int32()), tokens.field("text").take(own)]


def _rows_of_words(batch: pa.RecordBatch, mid: float, tolerance: float) -> pa.RecordBatch:
    at, words = _read(batch, mid, tolerance)
    return pa.RecordBatch.from_arrays([*_pages_of(batch, at), *words], names=["document_id", "page", "token_no", "column", "line", "rank", "text"])


def _text_of_words(batch: pa.RecordBatch, mid: float, tolerance: float) -> pa.RecordBatch:
    at, words = _read(batch, mid, tolerance)
    has, text = pa.array(np.diff(at) > 0), words[-1].cast(pa.string())
    known = np.append(0, np.cumsum(text.is_valid().to_numpy(zero_copy_only=False)))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(known[at], pa.int32()), text.drop_null()), " ")
    return pa.RecordBatch.from_arrays([batch.column("document_id"), batch.column("page"), joined], names=["document_id", "page", "words"]).filter(has)


def read_words(pages: DataFrame, page_width: float = 600.0, tolerance: float = 8.0, before: tuple[Step, ...] = ()) -> DataFrame:
    """[document_id, page, token_no, column, line, rank, text] of pages with tokens, which are read in two columns where most lines keep to one side.

    A page is a row and is read by itself; pages are bounded by :func:`page_tokens`. The steps ``before`` make its tokens in
    the same task. A token may bring its own ``token_no``; else its place in the array is its number.
    """
    steps = (*before, partial(_rows_of_words, mid=page_width / 2, tolerance=tolerance))
    return _in_tasks(pages, steps, "token_no int, column int, line int, rank int, text string")


def reading_order(tokens: DataFrame, page_width: float = 600.0, tolerance: float = 8.0) -> DataFrame:
    """[document_id, page, token_no, column, line, rank, text]: two columns are read one after the other."""
    own = F.array_sort(F.collect_list(F.struct(F.col("token_no").cast("int").alias("token_no"), "left", "bottom", "right", "top", "text")))
    return read_words(tokens.groupBy("document_id", "page").agg(own.alias("tokens")), page_width, tolerance)


def read_text(pages: DataFrame, images: DataFrame, page_width: float = 600.0, tolerance: float = 8.0, before: tuple[Step, ...] = ()) -> DataFrame:
    """[document_id, page, text] of pages as in :func:`read_words`: their words in order, then the page's images."""
    steps = (*before, partial(_text_of_words, mid=page_width / 2, tolerance=tolerance))
    return _with_images(_in_tasks(pages, steps, "words string"), images)


def page_text(ordered: DataFrame, images: DataFrame) -> DataFrame:
    """[document_id, page, text]: tokens in reading order, then the page's images."""
    return _with_images(ordered.groupBy("document_id", "page").agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY rank)").alias("words")), images)


def _with_images(words: DataFrame, images: DataFrame) -> DataFrame:
    tags = images.groupBy("document_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("uri")), lambda u: F.concat(F.lit(" [Image: "), u, F.lit("] "))), "").alias("tags"))
    joined = words.join(tags.hint("merge"), ["document_id", "page"], "full_outer")
    return joined.select("document_id", "page", F.trim(F.concat(F.coalesce("words", F.lit("")), F.coalesce("tags", F.lit("")))).alias("text"))


def captions(tokens: DataFrame, images: DataFrame) -> DataFrame:
    """[document_id, page, token_no, image_id, text]: tokens just below an image that start a caption."""
    i = images.select("document_id", "page", "image_id", F.col("left").alias("il"), F.col("right").alias("ir"), F.col("bottom").alias("ib"))
    centre = (F.col("left") + F.col("right")) / 2
    near = (F.col("ib") - F.col("top") >= 0) & (F.col("ib") - F.col("top") < 30) & (centre >= F.col("il") - 20) & (centre <= F.col("ir") + 20)
    joined = tokens.where(F.col("text").startswith("Fig")).join(i.hint("merge"), ["document_id", "page"]).where(near)
    return joined.select("document_id", "page", "token_no", "image_id", F.concat(F.lit("[Caption: "), "text", F.lit("]")).alias("text"))

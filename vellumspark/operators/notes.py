"""Annotations, tags, note merging, re-anchoring and packets."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as tx
from vellumspark.session import materialise, ship, spread


def tags_with_authors(tags: DataFrame, block_tags: DataFrame, annotations: DataFrame) -> DataFrame:
    """[id, name, source, author_ids]: tags with the distinct authors of notes on their blocks, comma-joined; ``source`` where the tags have it."""
    pairs = block_tags.join(annotations.select("block_id", "author_id").distinct().hint("merge"), "block_id").select("tag_id", "author_id").distinct()
    authors = pairs.groupBy("tag_id").agg(F.array_join(F.array_sort(F.collect_set("author_id")), ",").alias("author_ids"))
    return tags.join(authors.withColumnRenamed("tag_id", "id").hint("merge"), "id", "left").select("id", "name", *[c for c in ("source",) if c in tags.columns], "author_ids")


def tag_cooccurrence(block_tags: DataFrame) -> DataFrame:
    """[source, target, weight]: number of blocks that carry both tags, source before target.

    A block's tags are bounded by nature (a handful), so pairs are built inside the block.
    """
    per_block = block_tags.groupBy("block_id").agg(F.array_sort(F.collect_set("tag_id")).alias("t"))
    one = per_block.select(F.posexplode("t").alias("i", "source"), "t")
    pairs = one.select("source", F.explode(F.expr("slice(t, i + 2, size(t))")).alias("target"))
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight"))


def occurrences(text: Column, needle: Column) -> Column:
    """0-based code-point offsets of all (also overlapping) occurrences of a needle.

    A single one is found by searches. For more the text is cut before every occurrence, so one pass
    finds them; offsets are running lengths.
    """
    at = F.instr(text, needle)
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    lengths = F.transform(F.split(text, quoted, -1), lambda x: F.length(x))
    first = F.when(F.startswith(text, needle), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    state = F.struct(F.lit(0).alias("at"), first.alias("out"))
    cuts = F.slice(lengths, 1, F.greatest(F.size(lengths) - 1, F.lit(0)))
    found = F.aggregate(cuts, state, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"] + n)).alias("out")), lambda s: s["out"])
    found = F.when(F.call_function("locate", needle, text, at + 1) == 0, F.array(at - 1)).otherwise(found)
    return F.when((F.length(needle) > 0) & F.contains(text, needle), found).otherwise(F.array().cast("array<int>"))


#: Characters of a gram, most keys of a document that its blocks are compared with at a time, and most that are searched for one by one.
GRAM, KEY_SET, FEW_KEYS = 3, 512, 64

#: Most notes of a document that are searched for one by one, as more cost more than grams of the blocks; blocks that are searched at a time.
FEW_NOTES, BLOCK_SET = 512, 256


def _grams(c: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters of a text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{size}}}))"), 1))


def _keys(needle: Column) -> Column:
    """Strings of which a text that holds the needle holds every one, as words or as grams.

    Of three words or more the longest inner word, as it is a whole word of the text; else the
    needle's grams of characters. A needle shorter than a gram is its own.
    """
    inner = F.slice(F.split(needle, r"\s+"), 2, F.greatest(F.size(F.split(needle, r"\s+")) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return F.when(longest.isNotNull(), F.array(longest)).when(F.length(needle) >= GRAM, _grams(needle, GRAM)).otherwise(F.array(needle))


def _shared(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """[document_id, block_id, key] of blocks and the keys [document_id, key] of their document that they hold.

    Blocks are read once. A document's keys meet them as sets of bounded size: a small set is
    searched for in the text, a larger one in the text's words and grams.
    """
    sets = F.ceil(F.count("*").over(Window.partitionBy("document_id")) / KEY_SET)
    wanted = wanted.withColumn("_set", F.pmod(F.xxhash64("key"), sets)).groupBy("document_id", "_set").agg(F.collect_list("key").alias("wanted"))
    sizes = F.transform("wanted", lambda g: F.length(g))
    short = [F.when(F.array_contains(sizes, n), _grams(F.col("text"), n)).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM)]
    held = F.array_intersect("wanted", F.concat(F.split("text", r"\s+"), _grams(F.col("text"), GRAM), *short))
    held = F.when(F.size("wanted") <= FEW_KEYS, F.filter("wanted", lambda key: F.contains("text", key))).otherwise(held)
    near = blocks.select("document_id", "block_id", "text").join(wanted.hint("merge"), "document_id")
    return near.select("document_id", "block_id", F.explode(held).alias("key"))


def _holders(texts: pd.Series, needles: pd.Series) -> pd.Series:
    """Pairs of a needle and a text that holds it, as number of the needle * 2^32 + number of the text."""
    rows = []
    for some, wanted in zip(texts, needles, strict=True):
        found = {n: [k for k, text in enumerate(some) if text is not None and n in text] for n in set(wanted) if n is not None}
        rows.append([(i << 32) + k for i, n in enumerate(wanted) for k in found.get(n, ())])
    return pd.Series(rows)


def _searched(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs of a note and a block of its document that holds its needle, by a search for every needle.

    A document's notes meet its blocks as sets of bounded size and come out with the block, so neither is joined again.
    """
    ship(blocks.sparkSession)
    others, sides = [c for c in annotations.columns if c != "document_id"], [c for c in blocks.columns if c != "document_id"]
    notes = annotations.groupBy("document_id").agg(F.collect_list(F.struct(*others)).alias("_notes"))
    parts = blocks.repartition("document_id").groupBy("document_id", F.floor(F.col("sort_order") / BLOCK_SET).alias("_part")).agg(F.collect_list(F.struct(*sides)).alias("_blocks"))
    near = parts.join(notes.hint("merge"), "document_id").withColumn("_held", F.pandas_udf(_holders, "array<long>")(F.col("_blocks")["text"], F.col("_notes")["needle"]))
    near = near.select("document_id", "_notes", "_blocks", F.explode_outer("_held").alias("_p")).where("_p IS NOT NULL")
    note, block = F.get("_notes", F.shiftright("_p", 32).cast("int")), F.get("_blocks", F.col("_p").bitwiseAND(0xFFFFFFFF).cast("int"))
    return near.select("document_id", *[note[c].alias(c) for c in others], *[block[c].alias(c) for c in sides])


def _looked_up(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs of a note and a block of its document that may hold its needle, by keys.

    Every needle is looked up by one of its keys, that which the fewest blocks of the document hold.
    So what comes out is the pairs of a note and a block that share that key, and nothing else.
    """
    own = materialise(annotations.select("document_id", "annotation_id", F.explode(_keys(F.col("needle"))).alias("key")), "needle-keys")
    shared = materialise(_shared(own.select("document_id", "key").distinct(), blocks), "shared-keys")
    counts = shared.groupBy("document_id", "key").agg(F.count("*").alias("df"))
    # a key that no block holds is the rarest, and leaves its note without candidates
    counted = own.join(counts.hint("merge"), ["document_id", "key"], "left")
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("key"))).alias("r")
    chosen = counted.groupBy("document_id", "annotation_id").agg(rarest).where("r.df > 0").select("document_id", "annotation_id", "r.key")
    pairs = shared.join(chosen.hint("merge"), ["document_id", "key"]).select("document_id", "annotation_id", "block_id")
    return annotations.join(pairs.hint("merge"), ["document_id", "annotation_id"]).join(blocks.hint("merge"), ["document_id", "block_id"])


def _with_candidates(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pairs of a note (needle) and a block (text) of its document that may hold the needle.

    The notes of a document are searched for where they are few, else looked up by their keys.
    """
    counted = annotations.withColumn("_n", F.count("*").over(Window.partitionBy("document_id")))
    counted = materialise(counted, "needles")
    found = _searched(counted.where(F.col("_n") <= FEW_NOTES).drop("_n"), blocks)
    many = counted.where(F.col("_n") > FEW_NOTES).drop("_n")
    if many.isEmpty():
        return found
    theirs = blocks.join(many.select("document_id").distinct().hint("merge"), "document_id", "left_semi")
    return found.unionByName(_looked_up(many, theirs))


def reanchor(annotations: DataFrame, blocks: DataFrame, accept: float = 0.4) -> DataFrame:
    """Best anchor of every annotation: [annotation_id, block_id, start, end, confidence]; offsets are UTF-8 bytes.

    Candidates are exact occurrences of the trimmed text in blocks of the same document. A
    score of 0.5 gains 0.25 for a matching prefix and suffix each and loses up to 0.15 with the
    distance from the stored offset. Ties go to the first block, then the lowest offset.
    """
    target = tx.trimmed(F.col("highlighted_text"))
    a = annotations.select("document_id", "annotation_id", target.alias("needle"), "prefix", "suffix", "offset").where("needle <> ''")
    b = blocks.select("document_id", "block_id", "sort_order", "text")
    hits = _with_candidates(a, b).where(F.contains("text", "needle"))
    hits = hits.withColumn("i", F.explode_outer(occurrences(F.col("text"), F.col("needle")))).where("i IS NOT NULL")
    before = F.substr("text", F.lit(1), F.col("i"))
    start = F.octet_length(before)
    # context of the block beside the occurrence: as many bytes as the stored side, whole characters
    hits = hits.withColumns({"prefix": F.coalesce("prefix", F.lit("")), "suffix": F.coalesce("suffix", F.lit(""))})
    # no more characters than the stored side has bytes can take part, so windows are cut out first
    hits = hits.withColumns({"_a": F.expr("right(substr(text, 1, i), octet_length(prefix))"), "_z": F.expr("substr(text, i + length(needle) + 1, octet_length(suffix))")})
    fits = "array_max(filter(sequence(0, length({1})), k -> octet_length({2}) <= octet_length({0})))"
    left = F.expr("if(octet_length(_a) <= octet_length(prefix), _a, right(_a, {}))".format(fits.format("prefix", "_a", "right(_a, k)")))
    right = F.expr("if(octet_length(_z) <= octet_length(suffix), _z, left(_z, {}))".format(fits.format("suffix", "_z", "left(_z, k)")))
    clean_p, clean_s = tx.trimmed(F.coalesce("prefix", F.lit(""))), tx.trimmed(F.coalesce("suffix", F.lit("")))
    hits = hits.withColumns({"_l": left, "_r": right, "_p": clean_p, "_s": clean_s, "start": start})
    has_p = (F.col("_p") != "") & (F.col("_l") != "") & (F.contains("_l", F.expr("right(_p, 10)")) | F.contains("_p", "_l"))
    has_s = (F.col("_s") != "") & (F.col("_r") != "") & (F.contains("_r", F.expr("left(_s, 10)")) | F.contains("_s", "_r"))
    penalty = F.when(F.col("offset") > 0, F.least(F.lit(0.15), F.abs(F.col("start") - F.col("offset")) / 20000.0)).otherwise(0.0)
    score = F.lit(0.5) + F.when(has_p, 0.25).otherwise(0.0) + F.when(has_s, 0.25).otherwise(0.0) - penalty
    hits = hits.withColumn("score", score)
    best = Window.partitionBy("annotation_id").orderBy(F.desc("score"), "sort_order", "block_id", "start")
    top = hits.withColumn("_n", F.row_number().over(best)).where((F.col("_n") == 1) & (F.col("score") >= accept))
    return top.select(
        "annotation_id", "block_id", "start", (F.col("start") + F.octet_length("needle")).alias("end"), F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("score"))).alias("confidence")
    )


def orphans(annotations: DataFrame, anchored: DataFrame) -> DataFrame:
    """Annotations without an accepted anchor."""
    return annotations.join(anchored.select("annotation_id").hint("merge"), "annotation_id", "left_anti")


def anchored(annotations: DataFrame) -> DataFrame:
    """Annotations that are attached to a block."""
    return annotations.where(F.col("block_id").isNotNull())


def packetise(payloads: DataFrame, most: int = 512) -> DataFrame:
    """[tx, i, n, checksum, data]: payloads cut into packets of at most ``most`` UTF-8 bytes, whole characters.

    Each cut looks at the few bytes before it alone: it goes back over continuation bytes. An empty
    or null payload gives no packet.
    """
    last = "least(s.at + {0}, n)".format(most)
    inside = "substring(raw, {0} - {1} + 1, 1) BETWEEN X'80' AND X'BF'"
    cut = f"CASE WHEN {last} = n OR NOT ({inside.format(last, 0)}) THEN {last} WHEN NOT ({inside.format(last, 1)}) THEN {last} - 1 WHEN NOT ({inside.format(last, 2)}) THEN {last} - 2 ELSE {last} - 3 END"
    step = f"transform(array({cut}), e -> named_struct('at', e, 'ends', concat(s.ends, array(e))))[0]"
    fold = f"aggregate(sequence(1, cast(ceil(n / {most - 3}) AS int)), named_struct('at', 0, 'ends', cast(array() AS array<int>)), (s, k) -> CASE WHEN s.at = n THEN s ELSE {step} END, s -> s.ends)"
    raw = payloads.select("tx", F.col("payload").cast("binary").alias("raw")).withColumn("n", F.length("raw")).where("n > 0")
    ends = raw.withColumn("ends", F.expr(fold))
    # a text is cut inside its row, so that no packet carries all of it; every text has a part, and for an
    # outer explode Spark adds no filter on the array, which would do the cuts again before them
    part = "transform(ends, (e, k) -> cast(substring(raw, if(k = 0, 0, ends[k - 1]) + 1, e - if(k = 0, 0, ends[k - 1])) AS string))"
    rows = ends.select("tx", F.size("ends").alias("n"), F.expr(part).alias("parts")).select("tx", "n", F.posexplode_outer("parts").alias("i", "data"))
    return rows.select("tx", "i", "n", tx.checksum(F.col("data")).alias("checksum"), "data")


def reassemble(packets: DataFrame, checked: bool = False) -> DataFrame:
    """[tx, progress, payload]: packets with a right checksum, ordered; the payload only when complete.

    ``checked`` packets, as :func:`from_wire` gives them, have their checksums behind them.

    Of several packets with one index the last one stays: that with the highest ``arrival``. Where
    that is null, missing or equal, the greatest text stays (a null arrival comes first).
    """
    order = F.struct(F.col("arrival") if "arrival" in packets.columns else F.lit(0).alias("arrival"), "data")
    good = packets if checked else packets.where(tx.checksum(F.col("data")) == F.col("checksum"))
    # packets go to their transfer's task once, for both groupings
    good = good.repartition("tx").groupBy("tx", "i").agg(F.max("n").alias("n"), F.max(order)["data"].alias("data"))
    joined = good.groupBy("tx").agg(F.max("n").alias("n"), F.count("*").alias("got"), F.expr("listagg(data, '') WITHIN GROUP (ORDER BY i)").alias("all"))
    return joined.select("tx", (F.col("got") * 100 / F.col("n")).alias("progress"), F.when(F.col("got") == F.col("n"), F.col("all")).alias("payload"))


def to_wire(packets: DataFrame, *more: str) -> DataFrame:
    """[tx, i, line]: packets as they are sent, ``tx|i|n|checksum|data``; ``more`` names columns to keep."""
    return packets.select("tx", "i", *more, F.concat_ws("|", *[F.col(c).cast("string") for c in ("tx", "i", "n", "checksum", "data")]).alias("line"))


def from_wire(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packets [arrival, tx, i, n, checksum, data], rejects [arrival, line, reason]) of received lines [arrival, line].

    The data may hold ``|``. Reasons: ``fields`` (fewer than five, or no name of a transfer), ``number`` (an
    index or a count that is none, or an index outside the count), ``checksum``.
    """
    read = lines.select("arrival", "line", F.split("line", r"\|", 5).alias("_p"))
    read = read.select("arrival", "line", F.get("_p", F.lit(0)).alias("tx"), F.get("_p", F.lit(1)).try_cast("int").alias("i"), F.get("_p", F.lit(2)).try_cast("int").alias("n"), F.get("_p", F.lit(3)).alias("checksum"), F.get("_p", F.lit(4)).alias("data"))
    whole = F.coalesce(F.col("data").isNotNull() & (F.col("tx") != ""), F.lit(False))
    numbered = F.coalesce((F.col("i") >= 0) & (F.col("i") < F.col("n")), F.lit(False))
    reason = F.when(~whole, "fields").when(~numbered, "number").when(tx.checksum(F.col("data")) != F.col("checksum"), "checksum")
    read = read.withColumn("reason", reason)
    # written once: a filter on the reason would be pushed down and compute the checksum again in every use
    bad = F.col("reason").isNotNull()
    read = read.withColumns({"line": F.when(bad, F.col("line")), "data": F.when(~bad, F.col("data"))})
    read = materialise(read, "wire")
    return read.where("reason IS NULL").select("arrival", "tx", "i", "n", "checksum", "data"), read.where("reason IS NOT NULL").select("arrival", "line", "reason")


def split_conflict(df: DataFrame) -> DataFrame:
    """[id, ours, theirs] of notes with conflict markers."""
    pattern = r"(?s)<<<<<<< OURS\n(.*?)\n?=======\n(.*?)\n?>>>>>>> THEIRS"
    marked = df.where(F.contains("note_body", F.lit("<<<<<<< OURS")))
    return marked.select("id", F.regexp_extract("note_body", pattern, 1).alias("ours"), F.regexp_extract("note_body", pattern, 2).alias("theirs"))


def _edits(base: list[str], other: list[str]) -> list[tuple[int, int, list[str]]]:
    """Replacements (start, end, lines) that turn ``base`` into ``other``, by a shortest edit script."""
    n, m = len(base), len(other)
    frontier, trail = {1: 0}, []
    for d in range(n + m + 1):
        trail.append(dict(frontier))
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and frontier.get(k - 1, -1) < frontier.get(k + 1, -1))
            x = frontier[k + 1] if down else frontier[k - 1] + 1
            while x < n and x - k < m and base[x] == other[x - k]:
                x += 1
            frontier[k] = x
            if x >= n and x - k >= m:
                break
        else:
            continue
        break
    steps, x, y = [], n, m
    for d in range(len(trail) - 1, -1, -1):
        old, k = trail[d], x - y
        k0 = k + 1 if k == -d or (k != d and old.get(k - 1, -1) < old.get(k + 1, -1)) else k - 1
        x0 = old[k0]
        y0 = x0 - k0
        while x > x0 and y > y0:
            x, y = x - 1, y - 1
        if d:
            steps.append((x0, y0, x, y))
        x, y = x0, y0
    found: list[list] = []  # [start, end, lines, end in other]
    for x0, y0, x1, y1 in reversed(steps):
        if found and found[-1][1] == x0 and found[-1][3] == y0:
            found[-1] = [found[-1][0], x1, found[-1][2] + other[y0:y1], y1]
        else:
            found.append([x0, x1, other[y0:y1], y1])
    return [(a, b, lines) for a, b, lines, _ in found]


def _merge_one(base: str, ours: str, theirs: str) -> tuple[str, bool]:
    lines = [s.splitlines(keepends=True) for s in (base, ours, theirs)]
    changes = [(a, b, side, new) for side, text in ((0, lines[1]), (1, lines[2])) for a, b, new in _edits(lines[0], text)]
    clusters: list[list[tuple[int, int, int, list[str]]]] = []
    low = high = 0
    for c in sorted(changes, key=lambda c: (c[0], c[1], c[2])):
        joins = clusters and (max(low, c[0]) < min(high, c[1]) or (c[0] == c[1] == low == high))
        if joins:
            clusters[-1].append(c)
            high = max(high, c[1])
        else:
            clusters.append([c])
            low, high = c[0], c[1]
    out, at, conflict = [], 0, False
    for cluster in clusters:
        a, b = min(c[0] for c in cluster), max(c[1] for c in cluster)
        out += lines[0][at:a]

        def side(which: int, cluster: list = cluster, a: int = a, b: int = b) -> list[str]:
            result, spot = [], a
            for x, y, s, new in cluster:
                if s == which:
                    result += lines[0][spot:x] + new
                    spot = y
            return result + lines[0][spot:b]

        sides = {c[2] for c in cluster}
        mine, yours = side(0), side(1)
        if len(sides) == 1:
            out += mine if 0 in sides else yours
        elif mine == yours:
            out += mine
        else:
            conflict = True
            end = lambda part: "" if not part or part[-1].endswith("\n") else "\n"
            out += ["<<<<<<< OURS\n", *mine, end(mine), "=======\n", *yours, end(yours), ">>>>>>> THEIRS\n"]
        at = b
    return "".join([*out, *lines[0][at:]]), conflict


def _merge_rows(frames, columns: tuple[str, ...]):
    for pdf in frames:
        merged = [_merge_one(*row) for row in zip(*[pdf[c] for c in columns], strict=True)]
        yield pd.DataFrame({"id": pdf["id"], "merged": [m for m, _ in merged], "has_conflict": [c for _, c in merged]})


def merge_notes(notes: DataFrame) -> DataFrame:
    """Three-way merge of note versions: [id, merged, has_conflict] of [id, base, ours, theirs].

    Equal and one-sided versions are settled by expressions; an empty base gives a whole-text
    conflict. Only true three-way cases reach the line merge, a note at a time.
    """
    ship(notes.sparkSession)
    full = notes.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("base", "ours", "theirs")])
    settled = (
        F.when(F.col("ours") == F.col("theirs"), F.col("ours"))
        .when(F.col("ours") == F.col("base"), F.col("theirs"))
        .when(F.col("theirs") == F.col("base"), F.col("ours"))
        .when(F.col("base") == "", F.concat(F.lit("<<<<<<< OURS\n"), "ours", F.lit("\n=======\n"), "theirs", F.lit("\n>>>>>>> THEIRS")))
    )
    marked = full.withColumn("_m", settled)
    whole = (F.col("base") == "") & (F.col("ours") != F.col("theirs")) & (F.col("ours") != "") & (F.col("theirs") != "")
    easy = marked.where("_m IS NOT NULL").select("id", F.col("_m").alias("merged"), whole.alias("has_conflict"))
    hard = marked.where("_m IS NULL").drop("_m")
    done = hard.mapInPandas(partial(_merge_rows, columns=("base", "ours", "theirs")), f"id {dict(notes.dtypes)['id']}, merged string, has_conflict boolean")
    return easy.unionByName(done)


#: Spans that one task sorts and merges.
PART_SPANS = 500_000


def merge_highlights(spans: DataFrame) -> DataFrame:
    """Overlapping [block_id, start, end] spans merged; touching spans stay apart: [block_id, start, end, spans]."""
    spans = spread(spans.select("block_id", "start", "end"), F.lit(1), PART_SPANS, "block_id")
    order = Window.partitionBy("block_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") < reach, 0).otherwise(1)
    islands = spans.withColumn("_f", fresh).withColumn("_i", F.sum("_f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("block_id", "_i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("spans")).drop("_i")


def export_notes(documents: DataFrame, annotations: DataFrame) -> DataFrame:
    """[document_id, payload_json]: every document with its annotations, in order of id. Files: :mod:`vellumspark.sources.backup`."""
    grouped = annotations.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("id", "block_id", "highlighted_text", "note_body", "author_id"))).alias("annotations"))
    joined = documents.select("document_id", "title", "sha256_hash").join(grouped.hint("merge"), "document_id", "left")
    joined = joined.withColumn("annotations", F.coalesce("annotations", F.array().cast(dict(grouped.dtypes)["annotations"])))
    payload = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.struct("title", "sha256_hash").alias("document"), "annotations"))
    return joined.select("document_id", payload.alias("payload_json"))


def import_notes(payloads: DataFrame) -> DataFrame:
    """Annotations of exported payloads."""
    schema = "schema_version int, document struct<title:string,sha256_hash:string>, annotations array<struct<id:string,block_id:string,highlighted_text:string,note_body:string,author_id:string>>"
    parsed = payloads.select("document_id", F.from_json("payload_json", schema).alias("p"))
    return parsed.select("document_id", F.explode("p.annotations").alias("a")).select("document_id", "a.*")


def sync_report(outcome: DataFrame) -> DataFrame:
    """[applied, skipped, reanchored, orphaned] counts of an import's outcome column ``status``."""
    return outcome.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("applied", "skipped", "reanchored", "orphaned")])


def reanchor_loose(annotations: DataFrame, blocks: DataFrame) -> DataFrame:
    """Strict anchors first; what is left is tried whatever its case, then by prefix alone (0.4).

    Every occurrence is a candidate: 0.4, +0.2 for each side whose window, as long as the stored
    side, matches, and up to 0.15 less with the distance from the stored offset. As in
    :func:`reanchor`, an empty window matches nothing. The prefix wins over a score under 0.4.

    [annotation_id, block_id, start, end, confidence, mode].
    """
    # each step reads the one before it twice or more
    strict = materialise(reanchor(annotations, blocks).withColumn("mode", F.lit("strict")), "strict-anchors")
    rest = orphans(annotations, strict)
    best = Window.partitionBy("annotation_id").orderBy(F.desc("confidence"), "sort_order", "block_id", "start")
    rest = rest.withColumns({"prefix": F.coalesce("prefix", F.lit("")), "suffix": F.coalesce("suffix", F.lit("")), "wanted": tx.trimmed(F.col("highlighted_text"))}).where("wanted <> ''")
    rest = rest.select("document_id", "annotation_id", "wanted", "prefix", "suffix", "offset", tx.trimmed(F.col("prefix")).alias("p"), tx.trimmed(F.col("suffix")).alias("s"))
    texts = blocks.select("document_id", "block_id", "sort_order", "text")
    near = _with_candidates(rest.withColumn("needle", F.lower("wanted")), texts.withColumns({"raw": F.col("text"), "text": F.lower("text")}))
    near = near.withColumn("i", F.explode_outer(occurrences(F.col("text"), F.col("needle")))).where("i IS NOT NULL").drop("needle", "text").withColumnsRenamed({"wanted": "needle", "raw": "text"})
    near = near.withColumns({
        "l": F.expr("lower(right(substr(text, 1, i), length(prefix)))"), "r": F.expr("lower(substr(text, i + length(needle) + 1, length(suffix)))"),
        "start": F.expr("octet_length(substr(text, 1, i))"), "n": F.expr("octet_length(substr(text, i + 1, length(needle)))"), "p": F.lower("p"), "s": F.lower("s"),
    })
    has_p = F.expr("p <> '' AND l <> '' AND (contains(l, right(p, 10)) OR contains(p, right(l, 10)))")
    has_s = F.expr("s <> '' AND r <> '' AND (contains(r, left(s, 10)) OR contains(s, left(r, 10)))")
    penalty = F.when(F.col("offset") > 0, F.least(F.lit(0.15), F.abs(F.col("start") - F.col("offset")) / 20000.0)).otherwise(0.0)
    score = F.lit(0.4) + F.when(has_p, 0.2).otherwise(0.0) + F.when(has_s, 0.2).otherwise(0.0) - penalty
    cased = near.select("annotation_id", "block_id", "sort_order", "start", "n", score.alias("confidence"))
    cased = cased.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("annotation_id", "block_id", "start", (F.col("start") + F.col("n")).alias("end"), "confidence", F.lit("case").alias("mode"))
    cased = materialise(cased, "cased-anchors")
    # a prefix is tried only where the cased text gave no good anchor
    left = rest.where("p <> ''").join(cased.where("confidence >= 0.4").select("annotation_id").hint("merge"), "annotation_id", "left_anti")
    placed = _with_candidates(left.withColumn("needle", F.col("p")), texts).drop("needle").withColumnRenamed("wanted", "needle").withColumn("j", F.instr("text", F.col("p"))).where("j > 0")
    start = F.octet_length(F.expr("substr(text, 1, j - 1 + length(p))"))
    by_prefix = placed.select("annotation_id", "block_id", "sort_order", start.alias("start"), F.octet_length("needle").alias("n"), F.octet_length("text").alias("size"), F.lit(0.4).alias("confidence"))
    by_prefix = by_prefix.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    by_prefix = by_prefix.select("annotation_id", "block_id", "start", F.least(F.col("start") + F.col("n"), F.col("size")).alias("end"), "confidence", F.lit("prefix").alias("mode"))
    by_prefix = materialise(by_prefix, "prefix-anchors")
    weak = cased.join(by_prefix.select("annotation_id").hint("merge"), "annotation_id", "left_anti")
    return strict.unionByName(weak).unionByName(by_prefix)


def import_pipeline(incoming: DataFrame, content: DataFrame, documents: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annotations, orphans, report) of an import.

    ``incoming`` rows have the columns of ``content`` plus sha256_hash. Those of the same edition
    (the document's hash) win by their time stamp; those of another edition are re-anchored or
    put apart.
    """
    from vellumspark.operators.store import latest_wins

    known = documents.select("document_id", F.col("sha256_hash").alias("_own"))
    joined = incoming.join(known.hint("merge"), "document_id", "left")
    same = joined.where("sha256_hash = _own").drop("sha256_hash", "_own").select(*content.columns)
    # another edition, an unknown document or an unknown hash
    other = joined.where("NOT (sha256_hash <=> _own) OR sha256_hash IS NULL").drop("_own")
    merged = latest_wins(content, same, "annotation_id")
    anchors = reanchor(other, blocks)
    moved = other.drop("block_id", "offset").join(anchors.select("annotation_id", "block_id", F.col("start").alias("offset")).hint("merge"), "annotation_id").select(*content.columns)
    lost = orphans(other, anchors)
    newer = same.join(content.select("annotation_id", F.col("updated_at").alias("_t")).hint("merge"), "annotation_id", "left")
    status = newer.select(F.when(F.col("_t").isNull() | (F.col("updated_at") > F.col("_t")), "applied").otherwise("skipped").alias("status"))
    report = sync_report(status.unionByName(moved.select(F.lit("reanchored").alias("status"))).unionByName(lost.select(F.lit("orphaned").alias("status"))))
    return latest_wins(merged, moved, "annotation_id"), lost, report

"""Full-text, vector and hybrid search over block tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as tx
from vellumspark.session import materialise, ship


def tokenise(blocks: DataFrame) -> DataFrame:
    """Index build: [document_id, block_id, term, pos] of every term of every block."""
    return blocks.select("document_id", "block_id", F.posexplode(tx.terms(F.col("text"))).alias("pos", "term"))


def _words(query: str) -> list[str]:
    """Folded words of a query in order, on the driver: a query is a handful of words."""
    import re

    plain = query.lower().translate(str.maketrans(tx.MARKED, tx.PLAIN))
    return re.findall(r"[^\W_]+", plain)


def _query_terms(query: str) -> list[str]:
    """Distinct words of a query."""
    return list(dict.fromkeys(_words(query)))


def match(tokens: DataFrame, query: str) -> DataFrame:
    """[document_id, block_id] of blocks that hold every term of the query; none for an empty query."""
    words = _query_terms(query)
    hits = tokens.where(F.col("term").isin(words) if words else F.lit(False))
    return hits.groupBy("document_id", "block_id").agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(words)).drop("n")


def match_any(tokens: DataFrame, query: str) -> DataFrame:
    """Blocks that hold some term of the query (OR)."""
    words = _query_terms(query)
    return tokens.where(F.col("term").isin(words) if words else F.lit(False)).select("document_id", "block_id").distinct()


def match_prefix(tokens: DataFrame, prefix: str) -> DataFrame:
    """Blocks with a term that starts with the prefix (``term*``)."""
    return tokens.where(F.col("term").startswith(prefix)).select("document_id", "block_id").distinct()


def match_phrase(tokens: DataFrame, phrase: str) -> DataFrame:
    """Blocks with the phrase's words in a row: positions minus word numbers agree for every number, also of a repeated word."""
    words = _words(phrase)
    if not words:
        return match(tokens, phrase)
    numbers = F.create_map(*[x for w in dict.fromkeys(words) for x in (F.lit(w), F.array(*[F.lit(i) for i, v in enumerate(words) if v == w]))])
    hits = tokens.where(F.col("term").isin(words)).withColumn("number", F.explode(numbers[F.col("term")])).withColumn("at", F.col("pos") - F.col("number"))
    return hits.groupBy("document_id", "block_id", "at").agg(F.countDistinct("number").alias("n")).where(F.col("n") == len(words)).select("document_id", "block_id").distinct()


#: Words between the groups of a search text.
OPERATORS = ("AND", "OR", "NOT")


def _items(query: str) -> list[list[tuple[bool, list[tuple[list[str], bool]]]]] | None:
    """Alternatives of a search text, each a list of (negated, [(words, prefix)]); None where it doesn't read.

    Neighbouring items form one group, ``NOT`` negates a whole group, ``OR`` separates alternatives.
    """
    import re

    pieces = re.findall(r'"[^"]*"\*?|[\w]+\*?|\S', query)
    if any(not re.fullmatch(r'"[^"]*"\*?|\w+\*?', p) for p in pieces):
        return None
    alternatives: list = [[(False, [])]]
    for p in pieces:
        if p == "OR":
            alternatives.append([(False, [])])
        elif p in OPERATORS:
            alternatives[-1].append((p == "NOT", []))
        else:
            alternatives[-1][-1][1].append((_words(p), p.endswith("*")))
    groups = [g for a in alternatives for _, g in a]
    return alternatives if all(g and all(words for words, _ in g) for g in groups) else None


def search(tokens: DataFrame, query: str) -> DataFrame:
    """[document_id, block_id] of blocks that a search text finds: words, ``"a phrase"``, ``pre*``, ``AND``, ``OR``, ``NOT``.

    A text that doesn't read (a stray quote, sign or operator) is searched as one phrase; one
    without any word finds nothing. Every item is a run of words; a token stands for each word
    number that it can fill, and an item is found where all its numbers meet at one start.
    """
    alternatives = _items(query) or [[(False, [(_words(query), False)])]]
    items = [i for a in alternatives for _, g in a for i in g]
    fills = []
    for n, (words, prefix) in enumerate(items):
        for i, w in enumerate(words):
            fits = F.col("term").startswith(w) if prefix and i == len(words) - 1 else F.col("term") == w
            fills.append(F.when(fits, F.struct(F.lit(n).alias("item"), F.lit(i).alias("number"), F.lit(len(words)).alias("size"))))
    if not fills:
        return tokens.select("document_id", "block_id").where(F.lit(False))
    # an item of one word is found by each of its tokens, so that these need no start to meet at
    at = F.when(F.col("f.size") == 1, 0).otherwise(F.col("pos") - F.col("f.number")).alias("at")
    hits = tokens.select("document_id", "block_id", "pos", F.explode(F.array_compact(F.array(*fills))).alias("f")).select("document_id", "block_id", "f.*", at)
    longest = max(len(words) for words, _ in items)
    if longest < 63:  # numbers are bits of one long, so nothing but that is kept of a start
        filled = F.bit_or(F.expr("shiftleft(1L, number)")) == F.expr("shiftleft(1L, max(size)) - 1")
    else:
        filled = F.countDistinct("number") == F.max("size")
    found = hits.groupBy("document_id", "block_id", "item", "at").agg(filled.alias("whole")).where("whole")
    blocks = found.groupBy("document_id", "block_id").agg(F.collect_set("item").alias("has"))
    wanted, n = F.lit(False), 0
    for alternative in alternatives:
        each = F.lit(True)
        for negated, group in alternative:
            every = F.lit(True)
            for _ in group:
                every, n = every & F.array_contains("has", n), n + 1
            each = each & (~every if negated else every)
        wanted = wanted | each
    return blocks.where(wanted).select("document_id", "block_id")


def search_with_titles(tokens: DataFrame, blocks: DataFrame, documents: DataFrame, query: str) -> DataFrame:
    """[id, content, doc_title] of found blocks [document_id, block_id, text] with their documents' titles."""
    hits = blocks.join(search(tokens, query).select("block_id").hint("merge"), "block_id", "left_semi")
    titled = hits.join(documents.select(F.col("id").alias("document_id"), F.col("title").alias("doc_title")).hint("merge"), "document_id")
    return titled.select(F.col("block_id").alias("id"), F.col("text").alias("content"), "doc_title")


def block_vectors(blocks: DataFrame, cache: DataFrame) -> DataFrame:
    """[document_id, id, text, vector] of blocks with a vector in the cache [block_id, vector]."""
    return blocks.select("document_id", "block_id", "text").join(cache.select("block_id", "vector").hint("merge"), "block_id").select("document_id", F.col("block_id").alias("id"), "text", "vector")


def match_not(tokens: DataFrame, wanted: str, unwanted: str) -> DataFrame:
    """Blocks with all wanted terms and none of the unwanted."""
    return match(tokens, wanted).join(match_any(tokens, unwanted).hint("merge"), ["document_id", "block_id"], "left_anti")


def term_stats(tokens: DataFrame) -> DataFrame:
    """[term, document_frequency, occurrences]: blocks that hold a term, and its count."""
    per_block = tokens.groupBy("term", "block_id").agg(F.count("*").alias("tf"))
    return per_block.groupBy("term").agg(F.count("*").alias("document_frequency"), F.sum("tf").alias("occurrences"))


def bm25(tokens: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """[document_id, block_id, score] of blocks with all query terms, by BM25 over all indexed blocks.

    The corpus constants (blocks, average length, a frequency per query term) come from one
    aggregation each; a query has few terms.
    """
    words = _query_terms(query)
    lengths = tokens.groupBy("document_id", "block_id").agg(F.count("*").alias("len"), *[F.sum((F.col("term") == w).cast("int")).alias(f"tf{i}") for i, w in enumerate(words)])
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(words))]).first()
    score: Column = F.lit(0.0)
    for i in range(len(words)):
        df = stats[f"df{i}"] or 0
        idf = F.log(F.lit((stats["n"] - df + 0.5) / (df + 0.5)))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.lit(stats["avg"] or 1.0)))
    every = F.lit(bool(words))
    for i in range(len(words)):
        every = every & (F.col(f"tf{i}") > 0)
    return lengths.where(every).select("document_id", "block_id", score.alias("score"))


def rank_and_normalise(df: DataFrame, score: str, by: list[str], tie: str) -> DataFrame:
    """Adds rank (1-based, best first) and normalised score (0 to 1; all equal: 1) within ``by``."""
    group = Window.partitionBy(*by)
    low, high = F.min(score).over(group), F.max(score).over(group)
    best = group.orderBy(F.desc(score), tie)
    return df.withColumns({"rank": F.row_number().over(best), "normalised": F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(1.0)})


def keyword_candidates(tokens: DataFrame, query: str) -> DataFrame:
    """[document_id, id, score, rank]: BM25 candidates, ranked and min-max normalised per document."""
    scored = bm25(tokens, query).withColumnRenamed("block_id", "id")
    return rank_and_normalise(scored, "score", ["document_id"], "id").select("document_id", "id", F.col("normalised").alias("score"), "rank")


#: Characters of the texts whose places one task of :func:`hash_embedding` adds up.
PART_CHARS = 2_000_000


def hash_embedding(df: DataFrame, dims: int = 384) -> DataFrame:
    """Sparse hashed embeddings of texts: [id, dim, value], L2-normalised; an empty text is the first axis.

    Each word is hashed with three salts; every hash adds a signed unit at three places. The salt
    comes last, so a word's letters are folded once. Texts are shuffled by id before they grow to places;
    sums and norms then need no further shuffle.
    """
    cleaned = F.regexp_replace(F.lower("text"), r"[^\w\s]", "")
    # outer explodes: for others Spark filters on the array, which computes it a second time; a text without words keeps a row
    split = F.filter(F.split(cleaned, r"\s+"), lambda w: w != "")
    chars = df.agg(F.sum(F.length("text"))).first()[0] or 0
    # a number of its own, as Spark would join parts that are small before texts grow to places
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-chars // PART_CHARS))
    words = df.select("id", "text").repartition(parts, "id").select("id", F.explode_outer(split).alias("word"))

    def step(h: Column, x: Column) -> Column:
        low = (h * 33 + x).bitwiseAND(4294967295)
        return F.when(low >= 2147483648, low - 4294967296).otherwise(low)

    points = F.transform(F.filter(F.split("word", ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    folded = words.select("id", F.aggregate(points, F.lit(5381).cast("long"), step).alias("w"))
    after = step(F.col("w"), F.lit(ord("_")))
    hashed = folded.select("id", F.explode(F.array(*[step(after, F.lit(ord(str(salt)))) for salt in range(3)])).alias("h"))
    h = F.col("h")
    places = F.array(F.abs(h) % dims, F.abs(h * 31 + 17) % dims, F.abs(h * 97 + 43) % dims)
    signed = hashed.select("id", F.explode(places).alias("dim"), F.when(h.bitwiseAND(1) == 0, 1).otherwise(-1).alias("v"))
    summed = signed.groupBy("id", "dim").agg(F.sum("v").cast("double").alias("v"))
    cell = F.struct(F.col("dim").cast("int").alias("dim"), "v")
    cells = summed.groupBy("id").agg(F.collect_list(F.when((F.col("v") != 0) & F.col("dim").isNotNull(), cell)).alias("cells"), F.sqrt(F.sum(F.when(F.col("dim").isNotNull(), F.col("v") * F.col("v")))).alias("norm"))
    # what is left of a text without cells is the first axis
    found = cells.select("id", "norm", F.explode_outer("cells").alias("c"))
    return found.select("id", F.coalesce("c.dim", F.lit(0)).alias("dim"), F.when(F.col("c").isNull(), 1.0).otherwise(F.col("c.v") / F.col("norm")).alias("value"))


def dense(sparse: DataFrame, dims: int = 384) -> DataFrame:
    """[id, vector] of sparse embeddings."""
    cells = sparse.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "value"))).alias("m"))
    return cells.select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("vector"))


def similarities(targets: DataFrame, candidates: DataFrame, key: str, block: int = 1024) -> DataFrame:
    """[target_id, id, score]: cosine of every target with the candidates that share its key.

    The scores of a pair of blocks (see :func:`_on_grid`) are added up component by component, in the order
    in which :func:`vellumspark.functions.text.cosine` adds them.
    """
    return _on_grid(targets, candidates, key, _all_pairs, block)


def _vectors_by_size(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length; those that are null, empty or hold a null are left out."""
    rows, by_size = vectors.to_pylist(), {}
    for i, v in enumerate(rows):
        if v and None not in v:
            by_size.setdefault(len(v), []).append(i)
    return {n: (np.array(at), np.array([rows[i] for i in at], float)) for n, at in by_size.items()}


def _all_pairs(own: pa.Table, others: pa.Table) -> pa.Table:
    """The scores of all pairs of a cell."""
    scores = np.zeros((own.num_rows, others.num_rows))
    left, right = _vectors_by_size(own["vector"]), _vectors_by_size(others["vector"])
    for n in left.keys() & right.keys():
        (a, x), (b, y) = left[n], right[n]
        dot = np.zeros((len(a), len(b)))
        for i in range(n):
            dot += np.outer(x[:, i], y[:, i])
        scale = np.sqrt(np.cumsum(x * x, axis=1)[:, -1])[:, None] * np.sqrt(np.cumsum(y * y, axis=1)[:, -1])[None, :]
        scores[np.ix_(a, b)] = np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0)
    at = [np.repeat(np.arange(own.num_rows), others.num_rows), np.tile(np.arange(others.num_rows), own.num_rows)]
    return pa.table({"target_id": own["id"].take(pa.array(at[0])), "id": others["id"].take(pa.array(at[1])), "score": scores.ravel()})


def _cell(own: pa.Table, others: pa.Table, k: int) -> pa.Table:
    """The ``k`` best of ``others`` for every target of a cell, by one matrix product.

    The product picks the candidates, with room for its rounding; their scores are then added up in
    the order of the components, as :func:`vellumspark.functions.text.cosine` does.
    """
    targets, rows = own["vector"].to_pylist(), others["vector"].to_pylist()
    usable = lambda v: v is not None and len(v) > 0 and None not in v
    sizes_t, sizes_c = (np.array([len(v) if usable(v) else -1 for v in x]) for x in (targets, rows))
    scores = np.zeros((len(targets), len(rows)))
    for n in np.unique(sizes_t[sizes_t > 0]):
        a, b = np.flatnonzero(sizes_t == n), np.flatnonzero(sizes_c == n)
        if len(b):
            x, y = (np.array([v[i] for i in at], float) for v, at in ((targets, a), (rows, b)))
            norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
            scores[np.ix_(a, b)] = np.divide(x @ y.T, norms, out=np.zeros_like(norms), where=norms > 0)
    ids, out = others["id"].to_pylist(), ([], [], [])
    for t in range(len(targets)):
        least = np.partition(scores[t], len(rows) - k)[len(rows) - k] - 1e-9 if len(rows) > k else -np.inf
        near = np.flatnonzero(scores[t] >= least)
        exact = np.zeros(len(near))
        same = np.flatnonzero((sizes_c[near] == sizes_t[t]) & (sizes_t[t] > 0))
        if len(same):
            x, y = np.array(targets[t], float), np.array([rows[i] for i in near[same]], float)
            dot, own_norm, norm = (np.cumsum(v, axis=-1)[..., -1] for v in (x * y, x * x, y * y))
            scale = np.sqrt(own_norm) * np.sqrt(norm)
            exact[same] = np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0)
        best = sorted(zip((-exact).tolist(), [ids[i] for i in near], strict=True))[:k]
        out[0].extend([own["id"][t].as_py()] * len(best))
        out[1].extend(i for _, i in best)
        out[2].extend(-s for s, _ in best)
    return pa.table({"target_id": pa.array(out[0], own.schema.field("id").type), "id": pa.array(out[1], others.schema.field("id").type), "score": pa.array(out[2], pa.float64())})


def _on_grid(targets: DataFrame, candidates: DataFrame, key: str, cell: Callable[[pa.Table, pa.Table], pa.Table], block: int) -> DataFrame:
    """[target_id, id, score] of a function of two blocks, for every pair of blocks of targets and candidates with one key."""
    ship(targets.sparkSession)
    kinds = [dict(x.dtypes)["id"] for x in (targets, candidates)]
    counted = targets.groupBy(key).agg(F.count("*").alias("t")).join(candidates.groupBy(key).agg(F.count("*").alias("c")).hint("merge"), key)
    grid = materialise(counted.select(key, *[F.ceil(F.col(n) / block).cast("int").alias(n) for n in ("t", "c")]), "grid")

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        spread = rows.select(*[F.col(c).alias(c) for c in (key, "id", "vector")]).join(grid.hint("merge"), key).withColumn(f"_{own}", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        return spread.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select(key, "_t", "_c", "id", "vector")

    sides = [x.groupBy(key, "_t", "_c") for x in (dealt(targets, "t", "c"), dealt(candidates, "c", "t"))]
    return sides[0].cogroup(sides[1]).applyInArrow(cell, f"target_id {kinds[0]}, id {kinds[1]}, score double")


def nearest(targets: DataFrame, candidates: DataFrame, key: str, k: int, block: int = 2048) -> DataFrame:
    """[target_id, rank, id, score]: the ``k`` best candidates of every target among those that share its key, ties to smaller ids.

    A key's targets and candidates are dealt to blocks; every pair of blocks is a cell of a grid, one
    matrix product that leaves ``k`` rows a target. So no pairs are rows, a key that holds much of
    the table is spread over cells, and a task holds two blocks. Vectors of another length, without
    a norm, null or with null components score 0; ids may not be null.
    """

    def cell(own: pa.Table, others: pa.Table) -> pa.Table:
        return _cell(own, others, k)

    found = _on_grid(targets, candidates, key, cell, block)
    best = Window.partitionBy("target_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("target_id", "rank", "id", "score")


def one_to_many(target: list[float], candidates: DataFrame) -> DataFrame:
    """[id, score]: cosine of one literal target with all candidates."""
    literal = F.array(*[F.lit(float(x)) for x in target])
    return candidates.select("id", tx.cosine(literal, F.col("vector")).alias("score"))


def semantic_candidates(target: list[float], candidates: DataFrame, least: float = 0.15) -> DataFrame:
    """[document_id, id, score, rank] of candidates above ``least``, ranked per document."""
    literal = F.array(*[F.lit(float(x)) for x in target])
    scored = candidates.select("document_id", "id", tx.cosine(literal, F.col("vector")).alias("score")).where(F.col("score") > least)
    best = Window.partitionBy("document_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best))


def reciprocal_rank_fusion(keyword: DataFrame, semantic: DataFrame, limit: int = 20, k: int = 60) -> DataFrame:
    """Top ``limit`` ids of each document by the sum of 1 / (k + rank) over the lists that hold them."""
    a = keyword.select("document_id", "id", F.col("score").alias("keyword_score"), F.col("rank").alias("ra"))
    b = semantic.select("document_id", "id", F.col("score").alias("semantic_score"), F.col("rank").alias("rb"))
    fused = a.join(b.hint("merge"), ["document_id", "id"], "full_outer")
    total = F.coalesce(1.0 / (k + F.col("ra")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("rb")), F.lit(0.0))
    fused = fused.withColumn("combined_score", total)
    best = Window.partitionBy("document_id").orderBy(F.desc("combined_score"), "id")
    ranked = fused.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return ranked.select("document_id", "id", F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"), F.coalesce("semantic_score", F.lit(0.0)).alias("semantic_score"), "combined_score", "rank")


def context_for(ranked: DataFrame, budget: int) -> DataFrame:
    """Blocks in rank order while their running token count (words) fits the budget, per document."""
    order = Window.partitionBy("document_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("running_tokens", F.sum(tx.word_count(F.col("text"))).over(order)).where(F.col("running_tokens") <= budget)


def offsets(pieces: DataFrame, order: str, joint: int) -> DataFrame:
    """Pieces [document_id, order, text] with begin and end, their places in a text that joins them by ``joint`` characters."""
    before = Window.partitionBy("document_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("text") + joint).over(before), F.lit(0))
    return pieces.withColumn("begin", begin).withColumn("end", F.col("begin") + F.length("text"))


def overlapping(left: DataFrame, right: DataFrame, width: int = 1024) -> DataFrame:
    """Columns of both sides where spans [begin, end) of one document overlap; ``right``'s spans are named r_begin and r_end.

    Spans are listed under the bins of ``width`` characters that they touch, and a pair is kept in the
    first bin that both touch; so a long document's spans meet near ones only.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / width)))
    x, y = left.withColumn("_bin", bins("begin", "end")), right.withColumn("_bin", bins("r_begin", "r_end"))
    first = F.greatest(F.floor(F.col("begin") / width), F.floor(F.col("r_begin") / width))
    near = x.join(y.hint("merge"), ["document_id", "_bin"]).where((F.col("begin") < F.col("r_end")) & (F.col("r_begin") < F.col("end")))
    return near.where(F.col("_bin") == first).drop("_bin")


def answer_context(ranked: DataFrame, blocks: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """[document_id, seq, rank, text, running_tokens]: the chunks that answer a question, as far as the budget of words goes.

    ``ranked`` [document_id, id, rank] are found blocks (as of :func:`reciprocal_rank_fusion`), ``blocks``
    [document_id, id, begin, end] their places, ``chunks`` [document_id, seq, text, begin, end] those of chunks. A chunk has
    the best rank of the blocks that it overlaps; of equal ranks the earlier chunk comes first.
    """
    found = blocks.join(ranked.select("document_id", "id", "rank").hint("merge"), ["document_id", "id"]).select("document_id", "rank", F.col("begin").alias("r_begin"), F.col("end").alias("r_end"))
    hit = overlapping(chunks.select("document_id", "seq", "begin", "end"), found).groupBy("document_id", "seq").agg(F.min("rank").alias("best"))
    texts = chunks.select("document_id", "seq", "text").join(hit.hint("merge"), ["document_id", "seq"])
    ordered = texts.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy("best", "seq")))
    return context_for(ordered, budget).select("document_id", "seq", "rank", "text", "running_tokens")

"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

Letters are dealt to groups of about equal frequency. A word's path in the trie is its length, then
its number of letters of each group, one level a group. One inserted letter raises one count by
one (a surplus), a deleted letter lowers one (a deficit), a replaced one may do both; so a word
meets all its near words in a depth-first search that may spend one surplus and one deficit, and
the words of the leaves that it reaches are compared letter by letter.

On Spark the upper levels of the trie are the key: a word stands in the subtrie of its own
length and first counts, and visits the few subtries that these levels' budgets allow (only those
not before its own, so each pair is met once). The number of levels in the key grows with the
words, so that no subtrie has more than ``subtrie`` words; where even whole paths are shared by
more, the subtrie's words are dealt to blocks and visitors see every block. A task builds the lower
levels of a subtrie and sends all its visitors down together: every child gets those that can pay.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm import textblock as tb
from vellumspark.session import materialise, ship

#: Words of a subtrie that are compared without a further level.
LEAF_WORDS = 32
#: Pairs of words whose counts are compared at a time.
_PAIRS = 250_000
#: Visiting words in a partition, on average.
PARTITION_ROWS = 100_000


def letter_groups(words: DataFrame, groups: int, most: int = 1000) -> list[str]:
    """The letters of each group but the last; the ``most`` commonest letters are dealt, others belong to the last.

    The groups steer the search only; the result doesn't depend on them.
    """
    letters = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    common = [(r.n, r.c) for r in letters.orderBy(F.desc("n"), "c").limit(most).collect()]
    dealt, load = ["" for _ in range(groups)], [0] * groups
    for n, c in common:
        g = load.index(min(load))
        dealt[g] += c
        load[g] += n
    return sorted(dealt[:-1], key=lambda g: -len(g))


def _path(groups: list[str], levels: int) -> Column:
    """The length, and the counts of the first ``levels`` groups."""
    counts = [(F.length("word") - F.length(F.translate("word", g, ""))) for g in groups[:levels]]
    return F.array(F.length("word"), *counts)


def _steps(levels: int) -> list[tuple[int, ...]]:
    """What a near word's length and first counts may add to a word's own, itself and later paths only."""
    found = []
    for longer in (-1, 0, 1):
        for counts in _sparse(levels):
            up, down = counts.count(1), counts.count(-1)
            if up <= (longer >= 0) and down <= (longer <= 0):
                step = (longer, *counts)
                if step >= (0,) * len(step):
                    found.append(step)
    return found


def _sparse(levels: int) -> Iterator[tuple[int, ...]]:
    """Count changes with at most one surplus and one deficit."""
    for up, down in itertools.product(range(-1, levels), repeat=2):
        if up != down or up < 0:
            yield tuple(1 if i == up else -1 if i == down else 0 for i in range(levels))


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    wide = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
    return wide.astype(np.uint8) if not wide.size or wide.max() < 256 else wide


def _counts(codes: np.ndarray, group_of: dict[int, int], groups: int) -> np.ndarray:
    """Letters of each group in every word."""
    letters, inverse = np.unique(codes, return_inverse=True)
    group = np.array([group_of.get(c, groups - 1) for c in letters.tolist()], np.int64)[inverse].reshape(codes.shape)
    flat = (np.arange(len(codes))[:, None] * groups + group).reshape(-1)
    return np.bincount(flat, minlength=len(codes) * groups).reshape(-1, groups).astype(np.int32)


def one_edit_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x and y (code points; widths differ by at most one) are exactly one edit apart."""
    if x.shape[1] < y.shape[1]:
        x, y = y, x
    n = y.shape[1]
    if x.shape[1] == n:
        return (x != y).sum(axis=1) == 1
    if not n:
        return np.ones(len(x), bool)
    head, tail = x[:, :n] != y, x[:, 1:] != y
    first = np.where(head.any(axis=1), head.argmax(axis=1), n)
    last = np.where(tail.any(axis=1), n - 1 - tail[:, ::-1].argmax(axis=1), -1)
    return last < first


def _search(own: np.ndarray, own_codes: np.ndarray, seen: np.ndarray, seen_codes: np.ndarray, up: np.ndarray, down: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(visitor, word) pairs one edit apart: visitors ``seen`` go down the trie of ``own`` from a level.

    ``own`` is sorted by path from ``level`` on; ``up`` and ``down`` are what each visitor may still spend.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    depth = own.shape[1]
    room = max(1, min(_PAIRS, 8_000_000 // max(1, own_codes.shape[1])))

    def compared(low: int, high: int, who: np.ndarray, up: np.ndarray, down: np.ndarray, level: int) -> None:
        for a in range(low, high, room):
            b = min(high, a + room)
            step = max(1, room // (b - a))
            for at in range(0, len(who), step):
                some = slice(at, at + step)
                i, j = np.divmod(np.arange(len(who[some]) * (b - a)), b - a)
                if level < depth:
                    apart = own[a:b][None, :, level:] - seen[who[some]][:, None, level:]
                    fits = (np.maximum(apart, 0).sum(axis=2) <= up[some][:, None]) & (np.maximum(-apart, 0).sum(axis=2) <= down[some][:, None])
                    i, j = np.nonzero(fits)
                x, y = who[some][i], a + j
                near = one_edit_apart(seen_codes[x], own_codes[y])
                if near.any():
                    found.append((x[near], y[near]))

    stack = [(0, len(own), np.arange(len(seen)), up, down, level)]
    while stack:
        low, high, who, up, down, level = stack.pop()
        if high - low <= LEAF_WORDS or level == depth:
            compared(low, high, who, up, down, level)
            continue
        counts = own[low:high, level]
        edges = np.concatenate([[0], np.flatnonzero(counts[1:] != counts[:-1]) + 1, [high - low]])
        mine = seen[who, level]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            step = counts[a] - mine
            can = (step == 0) | ((step == 1) & (up > 0)) | ((step == -1) & (down > 0))
            if can.any():
                step = step[can]
                stack.append((low + a, low + b, who[can], up[can] - (step == 1), down[can] - (step == -1), level + 1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _best(words: list[str], place: np.ndarray, other: list[str], other_n: np.ndarray, other_place: np.ndarray) -> tuple:
    """(words, near words, largest n among them, its word) of the words at ``place``, from pairs."""
    rank = np.empty(len(other), np.int64)
    rank[np.array(sorted(range(len(other)), key=other.__getitem__), np.int64)] = np.arange(len(other))
    by = np.lexsort((rank[other_place], -other_n[other_place], place))
    place, other_place = place[by], other_place[by]
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    near = np.diff(np.append(first, len(place)))
    return [words[i] for i in place[first]], near, other_n[other_place[first]], [other[i] for i in other_place[first]]


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _subtrie(key: tuple, own: pa.Table, visitors: pa.Table, groups: list[str], levels: int) -> pa.Table:
    """Near words of a subtrie's words and of its visitors, as far as they meet here."""
    out = [_NEAR.empty_table()]
    if own.num_rows and visitors.num_rows:
        group_of = {ord(c): g for g, letters in enumerate(groups) for c in letters}
        depth = len(groups) + 1
        words, n = own["word"].to_pylist(), own["n"].to_numpy()
        codes = _codes(words)
        paths = _counts(codes, group_of, depth)
        by = np.lexsort(paths.T[::-1])
        words, n, codes, paths = [words[i] for i in by], n[by], codes[by], paths[by]
        guests, guest_n = visitors["word"].to_pylist(), visitors["n"].to_numpy()
        sizes = np.array([len(w) for w in guests])
        for longer in (-1, 0, 1):  # the subtrie's words are longer than the visitors by this
            some = np.flatnonzero(sizes == codes.shape[1] - longer)
            if not len(some):
                continue
            names = [guests[i] for i in some]
            guest_codes = _codes(names)
            guest_paths = _counts(guest_codes, group_of, depth)
            spent = paths[0, :levels] - guest_paths[:, :levels]
            up = (longer >= 0) - np.maximum(spent, 0).sum(axis=1)
            down = (longer <= 0) - np.maximum(-spent, 0).sum(axis=1)
            x, y = _search(paths, codes, guest_paths, guest_codes, up, down, levels)
            # in a word's own subtrie both words of a pair visit
            home = (spent == 0).all(axis=1) & (longer == 0)
            once = np.array([not home[i] or names[i] < words[j] for i, j in zip(x.tolist(), y.tolist(), strict=True)], bool)
            x, y = x[once], y[once]
            if len(x):
                out.append(pa.table(list(_best(names, x, words, n, y)), schema=_NEAR))
                out.append(pa.table(list(_best(words, y, names, guest_n[some], x)), schema=_NEAR))
    return pa.concat_tables(out)


def near_words(words: DataFrame, groups: int = 12, subtrie: int = 20_000) -> DataFrame:
    """[word, n_near, best, best_n] of the words of a written table [word, n] (distinct words) that have near words.

    ``best`` is the near word of largest n, the smallest such word in code-point order.
    """
    ship(words.sparkSession)
    letters = letter_groups(words, groups)
    levels = 1
    while True:
        sizes = words.groupBy(_path(letters, levels).alias("key")).agg(F.count("*").alias("c"))
        if levels == len(letters) or (sizes.agg(F.max("c")).first()[0] or 0) <= subtrie:
            break
        levels += 1
    keys = materialise(sizes.select("key", F.ceil(F.col("c") / subtrie).cast("int").alias("blocks")), "subtries")
    steps = F.array(*[F.array(*[F.lit(x) for x in step]) for step in _steps(levels)])
    path = _path(letters, levels)
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    own = words.withColumn("key", path).join(keys.hint("merge"), "key").select("key", block.alias("block"), "word", "n")
    paid = words.withColumns({"key": path, "step": F.explode(steps)}).select(F.zip_with("key", "step", lambda a, b: a + b).alias("key"), F.col("word").alias("word"), F.col("n").alias("n"))
    # where a subtrie has no words nobody visits; visitors see all blocks of a subtrie
    visits = paid.join(keys.hint("merge"), "key").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "word", "n")
    spark = words.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(_steps(levels)) * words.count() // PARTITION_ROWS)
    search = partial(_subtrie, groups=letters, levels=levels)

    def meet(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        return search(key, left, right)

    sides = [x.repartition(parts, "key", "block").groupBy("key", "block") for x in (own, visits)]
    met = sides[0].cogroup(sides[1]).applyInArrow(meet, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    merged = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.less")).alias("best_n"))


def variant_groups(words: DataFrame, ratio: int = 10, **options) -> DataFrame:
    """[word, form, root, n, n_near, form_n] of a table [word, n] of distinct words.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A
    word's form is its near word of largest n (the smallest word of these), if that n is at least
    ``ratio`` times its own; its root is reached by following forms to the last.

    Defined cases: words that are null or empty, or whose n is null, are left out; several rows of
    a word are added up; a word without near words has n_near 0, no form, and is its own root; an
    empty table gives an empty result; other columns are ignored.
    """
    given = words.where("word IS NOT NULL AND word <> '' AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    given = materialise(given, "words")
    near = near_words(given, **options)
    held = materialise(given.join(near.hint("merge"), "word", "left").withColumn("form", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))), "near-words")
    # n grows ratio-fold with every step to a form, so paths are short; each round doubles the steps taken
    most = held.agg(F.max("n")).first()[0] or 1
    rounds = math.ceil(math.log2(max(2, math.floor(math.log(max(most, 2), ratio)) + 1)))
    ends = held.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        ends = materialise(ends, "forms")
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("last"))
        ends = ends.join(further.hint("merge"), "root", "left").select("word", F.coalesce("last", "root").alias("root"))
    found = held.join(ends.hint("merge"), "word", "left")
    form_n = F.when(F.col("form").isNotNull(), F.col("best_n"))
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form_n.alias("form_n"))


def misspelt_words(docs: DataFrame, least: int = 7, occurrences: int = 2) -> DataFrame:
    """[word, n]: words of at least ``least`` letters of all texts, about every 31st with a letter left out.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z. With h = crc32 of
    "<doc_id>:<word>": where 31 divides h, letter h % length is left out. A null doc_id is written
    as an empty string; null texts have no words.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", upper, lower).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % 31 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    return variant_groups(misspelt_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))

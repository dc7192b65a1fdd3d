"""Periodic runs of words, by maximal pairs of an LCP-interval tree.

A run is a stretch of words with smallest period q, at least twice as long as q, that no
neighbouring word extends. Two equal factors of length l, d words apart, that differ in the word
before them and in the word behind them are a maximal pair; if d <= l, the stretch they span is
periodic with period d and cannot be extended, so it is a run as it stands.

The task builds, for the texts of a block together:

1. *Candidates.* A run of ``least`` words holds a pair with l >= least / 2, so only words that open
   a window of that many words which occurs twice in the text can take part.
2. *Suffix order and LCP values* by prefix doubling on word ranks; the ranks of every doubling
   give the exact LCP of any two suffixes.
3. *LCP intervals, bottom-up.* Each interval carries its positions in order, every one in the class
   of its left word. When a child joins its interval, each position of the smaller list looks for
   its neighbours in the larger one; a neighbour of another left-word class within the distance l
   is a maximal pair. Neighbours are enough: between the two parts of a run's pair at its smallest
   period the factor cannot occur again, as the period would be a power of a shorter one. So no
   class list is walked through, whatever the number of classes, and each merge costs the smaller
   list. Pairs at a multiple of the period span the same stretch and fall to the smallest one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm import textblock as tb
from vellumspark.session import ship

U64 = np.uint64
WORD = r"[^\x20\x09-\x0D]+"


def spans(block: tb.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first byte, end byte) of every word of a block; a long text part by part."""
    found, base = [], 0
    for part in block.parts():
        a, b, owner = part.words()
        found.append((part.span_hash(part.prefix_hash(), a, b), owner, a + base, b + base))
        base += len(part.data)
    if not found:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def doubled_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of the windows of 1, 2, 4, ... symbols from every place, until all windows differ.

    A rank is the number of smaller windows, so equal ranks mean equal windows. Windows that
    reach over the end must be told apart by a symbol that occurs once.
    """
    _, first, inverse, counts = np.unique(symbols, return_index=True, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse]
    levels, step, n = [rank], 1, len(symbols)
    active = np.flatnonzero(counts[inverse] > 1)
    while len(active):
        key = rank[active] * (n + 1) + rank[np.minimum(active + step, n - 1)]
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        whole = np.ones(len(key), bool)
        old = rank[active]
        whole[1:] = old[1:] != old[:-1]
        at = np.arange(len(key))
        begin, group = np.maximum.accumulate(np.where(fresh, at, 0)), np.maximum.accumulate(np.where(whole, at, 0))
        rank = rank.copy()
        rank[active] = old + begin - group
        levels.append(rank)
        ends = np.append(np.flatnonzero(fresh)[1:], len(key))
        sizes = np.repeat(np.diff(np.append(np.flatnonzero(fresh), len(key))), ends - np.flatnonzero(fresh))
        active = active[sizes > 1]
        step *= 2
    return levels


def common_prefix(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common prefixes of the suffixes x and y (x <> y)."""
    length = np.zeros(len(x), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        length += np.where(levels[t][x + length] == levels[t][y + length], 1 << t, 0)
    return length


def _maximal_pairs(order: list[int], shared: list[int], left: list[int], lower: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal pairs at a distance of at most their length.

    ``order`` are suffixes in lexicographic order, ``shared`` their LCP with the one before.
    """
    found: list[tuple[int, int, int]] = []

    def joined(x: list[int], y: list[int], depth: int) -> list[int]:
        if len(x) < len(y):
            x, y = y, x
        for place in y:
            spot = bisect_left(x, place)
            if spot:
                near = x[spot - 1]
                d = place - near
                if d <= depth and d + depth >= least and left[near] != left[place]:
                    found.append((near, d + depth, d))
            if spot < len(x):
                near = x[spot]
                d = near - place
                if d <= depth and d + depth >= least and left[near] != left[place]:
                    found.append((place, d + depth, d))
        if 8 * len(y) < len(x):
            for place in y:
                insort(x, place)
        else:
            x.extend(y)
            x.sort()
        return x

    stack: list[tuple[int, list[int]]] = []
    held: list[int] = []
    for place, depth in zip([*order, -1], [*shared, 0], strict=True):
        while stack and stack[-1][0] > depth:
            level, own = stack.pop()
            held = joined(own, held, level)
        if depth >= lower:
            if stack and stack[-1][0] == depth:
                stack[-1] = (depth, joined(stack[-1][1], held, depth))
            else:
                stack.append((depth, held))
        held = [place]
    return found


def runs_of(words: np.ndarray, owner: np.ndarray, n_texts: int, least: int) -> np.ndarray:
    """Rows (text number, start, length, period) of all runs of at least ``least`` words, sorted."""
    none = np.zeros((0, 4), np.int64)
    lower = max((least + 1) // 2, 1)
    bounds = tb.bounds_of(owner, n_texts)
    whole = np.flatnonzero(np.arange(len(words)) + lower <= bounds[owner + 1])
    if len(whole) < 2:
        return none
    window = tb.mix(owner[whole].astype(U64))
    for j in range(lower):
        window = (window ^ words[whole + j]) * U64(0x9FB21C651E98DF25)
        window ^= window >> U64(32)
    ordered = np.sort(window)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return none
    spot = np.minimum(np.searchsorted(twice, window), len(twice) - 1)
    starts = whole[twice[spot] == window]

    # texts with candidates, each closed by a symbol of its own; symbols of two texts never agree
    used = np.zeros(n_texts, bool)
    used[owner[starts]] = True
    mine = np.flatnonzero(used[owner])
    rank_of = np.cumsum(used) - 1
    place = np.arange(len(mine)) + rank_of[owner[mine]]
    n = len(mine) + int(used.sum())
    text = np.zeros(n, np.int64)
    text[place] = owner[mine]
    symbols = np.zeros(n, U64)
    symbols[place] = tb.mix(words[mine] ^ tb.mix(owner[mine].astype(U64)))
    stops = np.ones(n, bool)
    stops[place] = False
    ends = np.flatnonzero(stops)
    text[ends] = np.flatnonzero(used)
    symbols[ends] = tb.mix(np.arange(len(ends), dtype=U64) + U64(0xD1B54A32D192ED03))
    first = np.append(0, ends[:-1] + 1)[rank_of[text]]
    levels = doubled_ranks(symbols)
    local = np.full(len(words), -1, np.int64)
    local[mine] = place

    def ordered_suffixes(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = some[np.argsort(levels[-1][some])]
        shared = np.zeros(len(some), np.int64)
        shared[1:] = common_prefix(levels, some[:-1], some[1:])
        return some, shared

    some, shared = ordered_suffixes(local[starts])
    # a place stays if some equal window stands no farther off than its longest common prefix reaches
    reach = np.maximum(shared, np.append(shared[1:], 0))
    group = np.cumsum(shared < lower)
    by = np.lexsort((some, group))
    gap = np.full(len(some), n, np.int64)
    same = group[by][1:] == group[by][:-1]
    step = np.where(same, np.diff(some[by]), n)
    gap[by[1:]] = step
    gap[by[:-1]] = np.minimum(gap[by[:-1]], step)
    some = some[gap <= reach]
    if len(some) < 2:
        return none
    some, shared = ordered_suffixes(some)
    left = np.full(n, -1, np.int64)
    left[1:] = levels[0][:-1]
    left[first[some][some == first[some]]] = -1
    pairs = _maximal_pairs(some.tolist(), shared.tolist(), left.tolist(), lower, least)
    if not pairs:
        return none
    start, length, period = np.array(pairs, np.int64).T
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[keep], length[keep], period[keep]
    found = np.column_stack([text[start], start - first[start], length, period])
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _collapsed(block: tb.Block, owner: np.ndarray, a: np.ndarray, b: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of every text, joined by one space."""
    a, b, owner = a[kept], b[kept], owner[kept]
    n = len(block.data)
    edge = np.zeros(n + 1, np.int8)
    edge[a] += 1
    edge[b] -= 1
    take = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
    last = np.ones(len(a), bool)
    last[:-1] = owner[1:] != owner[:-1]
    take[b[~last]] = True
    data = block.data[take]
    data[tb._WS[data]] = 32
    sizes = block.per_text(take)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.Array.from_buffers(pa.large_string(), block.n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


@tb.tidied
def _scan(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, n_words, runs, collapsed)."""
    for batch in batches:
        for block in tb.blocks(batch.column(1)):
            words, owner, a, b = spans(block)
            runs = runs_of(words, owner, block.n, least)
            bounds = tb.bounds_of(owner, block.n)
            repeated = np.zeros(len(words) + 1, np.int64)
            begin = bounds[runs[:, 0]] + runs[:, 1]
            np.add.at(repeated, begin + runs[:, 3], 1)
            np.add.at(repeated, begin + runs[:, 2], -1)
            kept = np.cumsum(repeated[:-1]) == 0
            fields = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(block.first, block.n),
                    pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(runs[:, 0], np.arange(block.n + 1)), pa.int32()), fields),
                    _collapsed(block, owner, a, b, kept),
                ],
                ["id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """One row per row of ``docs``: [id_col, n_words, runs, collapsed].

    ``runs`` are all runs of at least ``least`` words, as (start, length, period) in words, by start
    and period; ``collapsed`` is the text with one period left of every run, its words joined by
    one space. Words are split at ASCII white space and compared as they are.

    Defined cases: a null, empty or blank text has no words, no runs and an empty collapsed text;
    a null id is kept as null; repeated rows are scanned each; a text of any length is one row of
    one task, whose arrays grow with its words; an empty table gives an empty result; other
    columns are ignored.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(partial(_scan, least=least), schema).withColumnRenamed("id", id_col)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """[doc_id, text], where about every tenth text repeats some of its words up to its end.

    With h = crc32 of the id and g = h div 10: where 10 divides h and there are n > 0 words, each
    word i >= a is the word a + (i - a) % p, a = g % n, p = 1 + (n - a) div (3 + g % 8). A null id
    leaves its text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # the words are bound once as a lambda's argument, as Spark would split the text again for every word
    rewritten = F.get(F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), lambda w: F.when(F.size(w) > 0, tail(w))), 0)
    return docs.select("doc_id", F.when(h % 10 == 0, rewritten).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document: their number, the longest, and digests of all runs and of the collapsed text."""
    found = periodic_runs(with_periodic_tails(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    found = found.withColumns({"best": best, "n_runs": F.size("runs").cast("long")})
    return found.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("best.length * 1000 div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

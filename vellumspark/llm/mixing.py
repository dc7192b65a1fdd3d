"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, repeated for up to ``max_epochs`` rounds.
A document's virtual finish time is the number of words its source has sent when it ends,
divided by the source's target. All queues merged by finish time, truncated at the word
budget, are the mix.

Nothing grows with a source: the shuffle order is cut into evenly spaced ranges of a hash, so
that a source's running total is an offset of its range (pre-aggregated sums, themselves summed
in two levels) plus a running sum inside the range. Equal documents share a hash; they are counted before, and
placed by their number among the equal ones. The global order by finish time is a range sort carried only as far
as the cut needs it: sums by evenly spaced ranges find the range in which the budget ends, which is divided again until few finish
times are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.session import materialise

#: Documents in a range of the shuffle order, on average, and ranges in a range of ranges.
RANGE_ROWS, RANGE_GROUP = 256, 4096
#: Ranges of finish times in one step, and finish times in the last one.
BINS = 4096
#: A row number made by Spark holds its partition above these bits.
_PART_BITS = 33

QUEUE = ["src", "none"]


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(flat, " "), "")), F.lit(0)).cast("long")


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``at``, their place in the global order from 0: sorted ranges, counted first."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("no", F.monotonically_increasing_id())
    placed = materialise(placed.withColumn("part", F.shiftright("no", _PART_BITS)), "mix-ranks")
    # one row a partition of the sort
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.col("no") - F.shiftleft(F.col("part"), _PART_BITS)
    return placed.join(before.hint("merge"), "part").withColumn("at", inside + F.col("before")).drop("no", "part", "before")


def _targets(sizes: DataFrame, weights: Sequence[float], budget: float, max_epochs: int) -> DataFrame:
    """[src, none, total, target] of every source from [src, none, total].

    Sources by code point, null last, take the weights in turn. Shares of the budget above
    ``max_epochs`` times a source's size are cut, and the excess is reshared by weight: the level
    (target by weight) of the uncut sources rises until no more source is cut by it.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    weighed = _ranked(sizes, "none", "src").select(*QUEUE, "total", turn.alias("w"), (F.col("total") * float(max_epochs)).alias("cap"))
    weighed = materialise(weighed, "mix-weights")
    goal = float(weighed.agg(F.sum("total")).first()[0] or 0) * float(budget)
    level, known = -1.0, -1
    while True:
        cut = F.col("cap") / F.col("w") <= level
        held, open_weight, n = weighed.agg(F.sum(F.when(cut, F.col("cap"))), F.sum(F.when(~cut, F.col("w"))), F.count_if(cut)).first()
        if n == known:
            break
        if not open_weight:
            level = float("inf")
            break
        level, known = (goal - (held or 0.0)) / open_weight, n
    target = F.least("cap", F.lit(level) * F.col("w")) if level < float("inf") else F.col("cap")
    return weighed.select(*QUEUE, "total", target.alias("target"))


def _cut(items: DataFrame, limit: float) -> float:
    """The last finish time up to which the sizes of [finish, size] stay within the limit; equal times go together."""
    low, high, n, total = items.agg(F.min("finish"), F.max("finish"), F.count("*"), F.sum("size")).first()
    if not n or total <= limit:
        return float("inf")
    sent, last = 0, 0.0
    while n > BINS and low < high:
        at = F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(high - low) * BINS), F.lit(BINS - 1))
        inside = items.where(F.col("finish").between(low, high)).groupBy(at.alias("bin"))
        found = inside.agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high"))
        for r in sorted(found.collect(), key=lambda r: r["bin"]):  # at most BINS rows
            if sent + r["size"] > limit:
                low, high, n = r["low"], r["high"], r["n"]
                break
            sent, last = sent + r["size"], r["high"]
    times = items.where(F.col("finish").between(low, high)).groupBy("finish").agg(F.sum("size").alias("size"))
    for r in sorted(times.collect(), key=lambda r: r["finish"]):  # at most BINS rows
        sent += r["size"]
        if sent > limit:
            break
        last = r["finish"]
    return last


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    budget: float = 1.0,
    max_epochs: int = 3,
    seed: str = "mix",
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id", "source"),
) -> DataFrame:
    """The mix's decision on every row: [row, size, source_size, target, taken, copies].

    ``row`` is a struct of the ``keep`` columns (``"*"``: all); size is in words, taken counts the words taken
    with repeats, copies how often the row is taken.

    Defined cases: a null text has no words; a null source is a source of its own, last in
    order; documents without words are never taken and change nothing; equal rows are
    separate documents, of which any may be the one that is taken once more; rows with null ids
    are shuffled by their texts; with no words at all every target is 0; ties in finish time are
    taken or left together; an empty table gives an empty result; columns may have any name.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text_col), F.lit(""))))
    rows = docs.select(
        F.struct(*keep).alias("row"), word_count(F.col(text_col)).alias("size"), F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("none"), key.alias("key")
    )
    rows = materialise(rows.withColumn("no", F.monotonically_increasing_id()), "mix-rows")
    targets = materialise(_targets(rows.groupBy(*QUEUE).agg(F.sum("size").alias("total")), weights, budget, max_epochs), "mix-targets")
    ranges = max(1, -(-rows.count() // RANGE_ROWS))

    # words that a source has sent before each of its distinct documents
    spot = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    distinct = rows.groupBy(*QUEUE, "key", "size").agg(F.count("*").alias("c"))
    distinct = materialise(distinct.withColumn("range", F.floor(spot * F.lit(ranges) / F.lit(2**32))), "mix-distinct")
    words = F.col("size") * F.col("c")
    sums = distinct.groupBy(*QUEUE, "range").agg(F.sum(words).alias("sum")).withColumn("group", F.floor(F.col("range") / RANGE_GROUP))

    def earlier(column: str, by: list[str], order: str) -> Column:
        return F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    groups = sums.groupBy(*QUEUE, "group").agg(F.sum("sum").alias("sum"))
    groups = groups.select(*QUEUE, "group", earlier("sum", QUEUE, "group").alias("before"))
    offsets = sums.withColumn("inside", earlier("sum", [*QUEUE, "group"], "range")).join(groups.hint("merge"), [*QUEUE, "group"]).join(targets.hint("merge"), QUEUE)
    offsets = materialise(offsets.select(*QUEUE, "range", (F.col("inside") + F.col("before")).alias("offset"), "total", "target"), "mix-offsets")
    run = F.coalesce(F.sum(words).over(Window.partitionBy(*QUEUE, "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = distinct.withColumn("run", run).join(offsets.hint("merge"), [*QUEUE, "range"])
    placed = placed.select(*QUEUE, "key", "size", "c", (F.col("run") + F.col("offset")).alias("before"), "total", "target")

    # a row's number among its equals: rows before it in their partitions of the written table, plus those of earlier partitions
    own = [*QUEUE, "key", "size"]
    narrow = rows.select("no", *own)
    found = materialise(narrow.join(placed.hint("merge"), own), "mix-order")
    equals = found.where("c > 1").withColumn("part", F.shiftright("no", _PART_BITS))
    parts = equals.groupBy(*own, "part").agg(F.count("*").alias("n"))
    parts = parts.select(*own, "part", earlier("n", own, "part").alias("ahead"))
    equals = equals.withColumn("j", F.row_number().over(Window.partitionBy(*own, "part").orderBy("no"))).join(parts.hint("merge"), [*own, "part"]).withColumn("j", F.col("j") + F.col("ahead"))
    columns = ["no", "size", "total", "target", (F.col("before") + F.col("j") * F.col("size")).alias("end")]
    ends = materialise(found.where("c = 1").withColumn("j", F.lit(1)).select(*columns).unionByName(equals.select(*columns)), "mix-ends")

    sent = ends.where("size > 0 AND target > 0")
    finish = F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: (e * F.col("total") + F.col("end")) / F.col("target")))
    cut = _cut(sent.select("size", finish.alias("finish")), float(targets.agg(F.sum("total")).first()[0] or 0) * budget)
    done = F.lit(0)
    for e in range(max_epochs):
        done = done + F.when((F.lit(e) * F.col("total") + F.col("end")) / F.when(F.col("target") > 0, F.col("target")) <= F.lit(cut), 1).otherwise(0)
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), done).otherwise(0)
    decided = ends.select("no", F.col("total").alias("source_size"), "target", copies.alias("copies"))
    joined = rows.select("row", "size", "no").join(decided.hint("merge"), "no")
    return joined.select("row", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken; columns unchanged, whatever their names."""
    taken = mix(docs, keep="*", **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document: [doc_id, size, source_size, target, taken]."""
    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return rows.select("row.doc_id", "size", "source_size", F.round("target", 4).alias("target"), F.col("taken").cast("long").alias("taken"))


ORACLE = {
    "op2_mix_sources": """
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT source, total, 3.0::DOUBLE * total AS cap,
        [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
l AS (SELECT *, ((sum(total) OVER ())::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
t AS (SELECT source, total, least(cap, coalesce(max(CASE WHEN cap / w > level THEN level END) OVER () * w, cap)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.total, t.target,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT (n * total + e)::DOUBLE / target AS f, size FROM p, (VALUES (0), (1), (2)) x(n) WHERE size > 0 AND target > 0),
c AS (SELECT f, sum(size) OVER (ORDER BY f RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through FROM i),
cut AS (SELECT max(f) AS f FROM c WHERE through <= (SELECT sum(size) FROM d))
SELECT doc_id, size, total AS source_size, round(target, 4) AS target,
  (CASE WHEN size > 0 AND target > 0 THEN size * (((e)::DOUBLE / target <= cut.f)::INT + ((total + e)::DOUBLE / target <= cut.f)::INT
     + ((2 * total + e)::DOUBLE / target <= cut.f)::INT) ELSE 0 END)::BIGINT AS taken
FROM p, cut
"""
}

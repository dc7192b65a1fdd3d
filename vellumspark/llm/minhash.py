"""Near-duplicate classes by DartMinHash sketches, banded joining and exact verification.

Method (weighted sets of five-word shingles, weight = number of occurrences):

1. *Darts.* Every element occupies one unit cell per unit of weight. Each cell receives a
   Poisson stream of hashed darts along a rank axis; a dart carries a coordinate, and the
   earliest dart of each coordinate is the sketch entry. Two sketches agree in a coordinate
   with a probability equal to the weighted Jaccard similarity. A text needs about
   ``t ln t + 2t`` darts whatever its length, so long texts only look at low ranks.
2. *Banded joining.* ``bands`` x ``rows`` coordinates become bucket keys. Texts with equal
   word sequences are folded into one representative first (grouped with partial
   aggregation), so a group of copies never meets itself in a bucket.
3. *Links.* Bucket members are compared with a bucket leader first and components are
   contracted. In buckets that still hold several components, the members outside the dominant
   one are compared with the others block by block, inside tasks that emit links alone. So no
   pairs of a group are written out, yet no link between different components is lost. A
   sketch estimate five standard errors below the threshold rejects a pair; the others are
   verified exactly on whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm import textblock as tb
from vellumspark.session import materialise, ship

U64 = np.uint64
#: Members of a bucket that meet in one task, on average.
BLOCK_ROWS = 500
#: Members of small buckets that share a task, on average.
TASK_ROWS = 2000
#: Rank intervals of cells whose darts are thrown at a time.
_DARTS = 300_000
#: Cumulative Poisson(1) probabilities for 0..19 darts in a unit cell and unit rank interval.
_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(20)])


def cells(words: np.ndarray, owner: np.ndarray, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell keys, text number) of all texts, in order of text."""
    h, who = tb.shingles(words, owner, n_texts, size)
    h = tb.sort_each(h, tb.bounds_of(who, n_texts))
    copy = tb.runs(h, who).astype(U64)
    return tb.mix(h + copy * U64(0xA24BAED4963EE407)), who


def darts(cell: np.ndarray, who: np.ndarray, n_texts: int, coords: int) -> np.ndarray:
    """Sketches (n_texts x coords) of 64-bit dart identities; rows without cells stay 0."""
    out, earliest = np.zeros(n_texts * coords, U64), np.full(n_texts * coords, np.inf)
    weight = np.bincount(who, minlength=n_texts)
    limit = (coords * np.log(coords) + 2 * coords) / np.maximum(weight, 1)
    todo = weight > 0
    while todo.any():
        mine = np.flatnonzero(todo[who])
        levels = np.ceil(limit[who[mine]]).astype(np.int64)
        # some cells at a time: short texts need many rank intervals, long ones have many cells
        reach = np.cumsum(levels) // _DARTS
        for part in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(reach)) + 1):
            some = levels[part]
            c, w = np.repeat(cell[mine[part]], some), np.repeat(who[mine[part]], some)
            level = np.arange(len(c)) - np.repeat(np.cumsum(some) - some, some)
            key = tb.mix(c ^ (level.astype(U64) * U64(0x8CB92BA72F3D8DD7)))
            hits = np.searchsorted(_POISSON, (key >> U64(11)).astype(float) * 2.0**-53, side="right")
            key, w, level = np.repeat(key, hits), np.repeat(w, hits), np.repeat(level, hits)
            turn = np.arange(len(key)) - np.repeat(np.cumsum(hits) - hits, hits)
            dart = tb.mix(key + (turn.astype(U64) + U64(1)) * U64(0xC2B2AE3D27D4EB4F))
            rank = level + (dart >> U64(11)).astype(float) * 2.0**-53
            low = rank <= limit[w]
            dart, w, rank = dart[low], w[low], rank[low]
            slot = w * coords + (tb.mix(dart ^ U64(0x165667B19E3779F9)) % U64(coords)).astype(np.int64)
            late_first = np.argsort(rank)[::-1]
            slot, dart, rank = slot[late_first], dart[late_first], rank[late_first]
            sooner = rank < earliest[slot]
            slot, dart, rank = slot[sooner], dart[sooner], rank[sooner]
            out[slot], earliest[slot] = dart, rank
        missing = (out.reshape(n_texts, coords) == 0).any(axis=1) & todo
        limit[missing] *= 2
        todo = missing
    return out.reshape(n_texts, coords)


@tb.tidied
def _sketch(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(id, print, text) -> (id, print, digest, sketch, buckets)."""
    coords = bands * rows
    salt = tb.mix(np.arange(1, bands + 1, dtype=U64))
    for batch in batches:
        for block in tb.blocks(batch.column(2)):
            words, owner = block.word_hashes()
            sketch = darts(*cells(words, owner, block.n, size), block.n, coords)
            band = np.zeros((block.n, bands), U64)
            for k in range(rows):
                band = tb.mix(band * U64(31) + sketch[:, k * bands : (k + 1) * bands] + salt)
            at = tb.bounds_of(owner, block.n)
            full = np.diff(at) > 0
            digest = [hashlib.blake2b(words[i:j].tobytes(), digest_size=16).digest() if j > i else None for i, j in zip(at[:-1], at[1:], strict=True)]
            short = sketch.astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i).slice(block.first, block.n) for i in range(2)],
                    pa.array(digest, pa.binary()),
                    pa.array([r.tobytes() if f else None for r, f in zip(short, full, strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1) * bands, pa.int32()), pa.array(band.reshape(-1).view(np.int64))),
                ],
                ["id", "print", "digest", "sketch", "buckets"],
            )


class _Cells:
    """Sorted cells of texts by node; a task keeps them up to a bound, as they come back in many pairs of a class."""

    def __init__(self, size: int, most: int = 4_000_000):
        self.size, self.most, self.room = size, most, 0
        self.kept: dict[int, np.ndarray] = {}

    def load(self, texts: dict[int, str]) -> None:
        if self.room > self.most:
            self.kept, self.room = {}, 0
        fresh = [node for node in texts if node not in self.kept]
        for block in tb.blocks(pa.array([texts[node] for node in fresh], pa.string())):
            cell, who = cells(*block.word_hashes(), block.n, self.size)
            bound = tb.bounds_of(who, block.n)
            self.room += len(cell)
            for node, i, j in zip(fresh[block.first : block.first + block.n], bound[:-1], bound[1:], strict=True):
                self.kept[node] = np.sort(cell[i:j])

    def alike(self, left: int, right: int, threshold: float) -> bool:
        x, y = self.kept[left], self.kept[right]
        if min(len(x), len(y)) < threshold * max(len(x), len(y)):
            return False
        both = np.concatenate([x, y])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        return common > 0 and common >= threshold * (len(x) + len(y) - common)


def _between(key: tuple, apart: pd.DataFrame, members: pd.DataFrame, size: int, threshold: float, least: float) -> pd.DataFrame:
    """Links of open members with members of the same bucket in other components; one block of some buckets.

    A pair that shares several buckets is handled in the first of them only. One link of an open
    member to a component is enough: its other candidates of that component are skipped.
    """
    found: list[tuple] = []
    if len(apart) and len(members):
        members = members.sort_values("bucket", kind="stable", ignore_index=True)
        (sa, ba), (sb, bb) = ((np.frombuffer(b"".join(d["sketch"]), np.uint16).reshape(len(d), -1), np.stack(d["buckets"].to_list())) for d in (apart, members))
        texts, nodes, comps = members["text"].to_list(), members["node"].to_numpy(), members["component"].to_numpy()
        where = members["bucket"].to_numpy()
        begin, end = (np.searchsorted(where, apart["bucket"].to_numpy(), side=s) for s in ("left", "right"))
        kept = _Cells(size)
        for i, (a, bucket, component, text) in enumerate(zip(apart["node"], apart["bucket"], apart["component"], apart["text"], strict=True)):
            band = int(np.flatnonzero(ba[i] == bucket)[0])
            near = begin[i] + np.flatnonzero(comps[begin[i] : end[i]] != component)
            near = near[(bb[near] == ba[i]).argmax(axis=1) == band]
            near = near[(sb[near] == sa[i]).mean(axis=1) >= least]
            if not len(near):
                continue
            kept.load({int(a): text} | {int(nodes[j]): texts[j] for j in near})
            done: set = set()
            for j in near:
                if comps[j] not in done and kept.alike(int(a), int(nodes[j]), threshold):
                    done.add(comps[j])
                    found.append((a, nodes[j]))
    return pd.DataFrame(found, columns=["a", "b"])


@tb.tidied
def _verify(batches: Iterator[pa.RecordBatch], size: int, threshold: float, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sketch_a, sketch_b, text_a, text_b) whose exact weighted similarity reaches the threshold.

    Pairs whose estimate stays below ``least`` are not compared further.
    """
    kept = _Cells(size)
    for whole in batches:
        for at in range(0, whole.num_rows, 128):
            batch = whole.slice(at, 128)
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            batch = batch.filter(pa.array((x == y).mean(axis=1) >= least))
            pairs = list(zip(*[batch.column(i).to_pylist() for i in range(2)], strict=True))
            kept.load(dict(zip(batch.column(0).to_pylist() + batch.column(1).to_pylist(), batch.column(4).to_pylist() + batch.column(5).to_pylist(), strict=True)))
            mask = pa.array([kept.alike(a, b, threshold) for a, b in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of a written table of edges (a, b): [id, component], the smallest id.

    Alternates large-star and small-star steps; each is an aggregation of minima and a
    join, so a hub of any degree is pre-aggregated and never gathered in one group.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # the edges are a written table, so Spark joins these aggregates on measured sizes
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        # done once every node points at one root that points nowhere
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            edges.select(F.col("b").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into"))
        )
        if ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR (out = 1 AND into = 1)").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _relabel(current: DataFrame | None, links: DataFrame) -> DataFrame:
    """[id, component] after joining the components of linked ids; ids not listed are their own.

    Both inputs are written tables, so Spark plans the joins on measured sizes.
    """
    if current is None:
        return materialise(components(links), "components")
    a = current.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    b = current.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    lifted = links.join(a, "a", "left").join(b, "b", "left")
    grown = materialise(components(materialise(lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), "links")), "roots")
    roots = grown.select(F.col("id").alias("component"), F.col("component").alias("root"))
    moved = current.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    fresh = grown.join(current.select("id"), "id", "left_anti")
    return materialise(moved.unionByName(fresh), "components")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    threshold: float = 0.8,
    bands: int = 32,
    rows: int = 5,
) -> DataFrame:
    """One row per distinct id: [id, class_id], class_id = smallest id of its near-duplicate class.

    Classes are the connected components of pairs with a weighted Jaccard similarity of
    ``size``-word shingles of ``threshold`` or more. Words are split at ASCII white space and
    compared as they are. A text of fewer than ``size`` words has one shingle, all its words.

    Defined cases: null, empty and blank texts are never linked (class_id = their own id);
    rows with a null id are left out; rows that share an id count as one document; other
    columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text_col)).alias("print"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    kind = dict(base.dtypes)["id"]
    schema = f"id {kind}, print binary, digest binary, sketch binary, buckets array<bigint>"
    sketched = materialise(base.mapInArrow(partial(_sketch, size=size, bands=bands, rows=rows), schema), "sketches")
    worded = sketched.where(F.col("digest").isNotNull())
    # one node for each word sequence, whoever holds it and how often
    reps = worded.groupBy("digest").agg(F.min(F.struct("id", "print", "sketch", "buckets")).alias("r")).select("digest", "r.*")
    reps = materialise(reps.withColumn("node", F.monotonically_increasing_id()), "representatives")

    placed = reps.select("node", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1").drop("n")
    placed = materialise(placed.join(shared.hint("merge"), "bucket"), "buckets")
    wanted = reps.select("id", "print", "node", "sketch", "buckets").join(placed.select("node").distinct().hint("merge"), "node", "left_semi")
    # equal rows count once, so a node has one text
    texts = base.where(F.col("text").isNotNull()).groupBy("id", "print").agg(F.first("text").alias("text"))
    held = materialise(texts.join(wanted.hint("merge"), ["id", "print"]).select("node", "sketch", "buckets", "text"), "bucket-texts")
    slack = 5 * (threshold * (1 - threshold) / (bands * rows)) ** 0.5

    def links(pairs: DataFrame) -> DataFrame:
        a, b = (held.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.col("text").alias(f"t{x}")) for x in ("a", "b"))
        both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "sa", "sb", "ta", "tb")
        return materialise(both.mapInArrow(partial(_verify, size=size, threshold=threshold, least=threshold - slack), "a bigint, b bigint"), "links")

    comp = _relabel(None, links(placed.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()))

    # of every bucket with several components: the dominant one
    own = placed.select("bucket", "node").join(comp.withColumnRenamed("id", "node"), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    parts = own.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    sizes = parts.groupBy("bucket").agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.max(F.struct("c", "component")).alias("d"))
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    still = sizes.where("k > 1").select("bucket", "n", F.col("d.component").alias("main"), blocks(F.col("n")).alias("parts"), blocks(F.col("n") - F.col("d.c")).alias("open_parts"))
    still = materialise(still, "open-buckets")
    crowd = still.agg(F.sum("n")).first()[0]
    if crowd:
        # members outside the dominant component are the only ones whose links are still open; they
        # meet all members of their bucket, block by block, inside tasks that emit links alone
        both = own.join(still, "bucket").join(held.hint("merge"), "node")
        spread = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        slot = F.pmod(F.xxhash64("bucket"), F.lit(max(1, crowd // TASK_ROWS))).cast("int")
        both = both.withColumn("slot", slot)
        columns = ["slot", "bucket", "x", "y", "node", "component", "sketch", "buckets", "text"]
        apart = both.where("component <> main").withColumn("x", spread("open_parts")).withColumn("y", every("parts")).select(*[F.col(c).alias(c) for c in columns])
        members = both.withColumn("y", spread("parts")).withColumn("x", every("open_parts")).select(*[F.col(c).alias(c) for c in columns])
        between = partial(_between, size=size, threshold=threshold, least=threshold - slack)
        pairs = apart.groupBy("slot", "x", "y").cogroup(members.groupBy("slot", "x", "y")).applyInPandas(between, "a bigint, b bigint")
        comp = _relabel(comp, materialise(pairs, "links"))

    # ids with several texts join the components of all their texts
    ids = materialise(worded.groupBy("id").agg(F.min("digest").alias("digest"), F.max("digest").alias("other")), "ids")
    several = ids.where("digest <> other")
    if not several.isEmpty():
        named = [reps.select(F.col("digest").alias(c), F.col("node").alias(n)) for c, n in (("digest", "a"), ("more", "b"))]
        more = worded.select("id", F.col("digest").alias("more")).join(several.select("id", "digest").hint("merge"), "id").where("more <> digest").select("digest", "more").distinct()
        comp = _relabel(comp, materialise(more.join(named[0].hint("merge"), "digest").join(named[1].hint("merge"), "more").select("a", "b"), "id-links"))

    # the smallest id of every component; nodes without links have their own smallest id
    linked = comp.select(F.col("id").alias("node"), "component").unionByName(comp.select(F.col("component").alias("node"), "component").distinct())
    linked = linked.join(reps.select("node", "id").hint("merge"), "node")
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    linked = linked.join(least.hint("merge"), "component").select("node", "least")
    classes = reps.select("digest", "node", "id").join(linked.hint("merge"), "node", "left").select("digest", F.coalesce("least", "id").alias("class_id"))
    found = ids.select("id", "digest").join(classes.hint("merge"), "digest").select("id", "class_id")
    blank = sketched.where(F.col("digest").isNull()).select("id").distinct().join(ids.select("id").hint("merge"), "id", "left_anti")
    return found.unionByName(blank.select("id", F.col("id").alias("class_id"))).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that represent their near-duplicate class; columns unchanged.

    A document is an id: of the id that stands for its class every different text is kept, once
    for all its rows with that text (null is a text here). Rows with a null ``doc_id`` can't be
    named in a class and are kept.
    """
    print_ = "_print" + "_" * max([0, *(len(c) for c in docs.columns)])
    classes = near_duplicates(docs.select("doc_id", "text"), **options)
    chosen = classes.where("doc_id = class_id").select("doc_id")
    kept = docs.where("doc_id IS NOT NULL").join(chosen.hint("merge"), "doc_id", "left_semi")
    # the join has brought a document's rows together, so this is no further shuffle
    kept = kept.withColumn(print_, F.md5("text")).dropDuplicates(["doc_id", print_]).drop(print_)
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document: [doc_id, class_id]."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op3_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, s, count(*) AS n FROM s GROUP BY ALL),
z AS (SELECT doc_id, sum(n) AS z FROM c GROUP BY ALL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS i FROM c a JOIN c b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE i >= 0.8 * (x.z + y.z - i)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT g.b, r.reach FROM r JOIN g ON g.a = r.id)
SELECT id AS doc_id, min(reach) AS class_id FROM r GROUP BY id
"""
}

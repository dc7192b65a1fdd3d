"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length (Euclidean norm) into buckets of bounded size; a range of norms
that holds too many vectors is salted into several buckets, so equal vectors never meet in one
group. Queries are cut into blocks of bounded size. A first pass over the longest buckets gives
each query a lower bound of its k-th best score. For every (query block, bucket) pair the
bucket's longest vector then bounds all products: pairs that can't reach any query's bound are
never built. Inside a pair the local cosine threshold (bound over both norms) chooses the
pruning: *coordinate* pruning where it is high (a vector can only reach it if its largest
coordinates of the query fit, by Cauchy-Schwarz on the rest), *length* pruning where it is low.
What is left is verified with exact integer products; the k best of each bucket are merged per
query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.session import materialise, ship

#: Vectors in a bucket and queries in a block, on average.
BUCKET_ROWS, BLOCK_ROWS = 2048, 1024
#: Buckets that one task pairs with all blocks of queries, on average.
LANE_BUCKETS = 1000
#: Products and norms below this are exact in float64.
_EXACT = float(2**52)


def _integers(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) -> (id, dims, norm, packed int64 components); vectors with null or non-finite components are left out."""
    for batch in batches:
        vectors = batch.column(1)
        dims = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
        x = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
        owner = np.repeat(np.arange(len(dims)), dims)
        fine = np.bincount(owner, ~np.isfinite(x), minlength=len(dims)) == 0
        y = np.clip(np.floor(x[fine[owner]] * scale), -(2.0**62), 2.0**62)
        number = np.cumsum(fine) - 1
        norm = np.sqrt(np.bincount(number[owner[fine[owner]]], y * y, minlength=int(fine.sum())))
        ends = np.concatenate([[0], np.cumsum(8 * dims[fine])]).astype(np.int64)
        packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(fine.sum()), [None, pa.py_buffer(ends), pa.py_buffer(y.astype("<i8"))])
        ids = batch.column(0).filter(pa.array(fine))
        yield pa.RecordBatch.from_arrays([ids, pa.array(dims[fine], pa.int32()), pa.array(norm), pc.cast(packed, pa.binary())], ["id", "dims", "norm", "packed"])


def _products(q: np.ndarray, c: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer products of all rows of q and c; clamped to the range of a long."""
    if bound < _EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    whole = q.astype(object) @ c.astype(object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of (score, id): highest scores, ties to the smaller id, without ``own``."""
    other = ids != own
    score, ids = score[other], ids[other]
    order = np.unique(ids)
    if len(order) < len(ids):  # repeated rows: the best of each id
        best = np.lexsort((-score, ids))
        first = np.ones(len(best), bool)
        first[1:] = ids[best][1:] != ids[best][:-1]
        score, ids = score[best][first], ids[best][first]
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = score >= least
        score, ids = score[near], ids[near]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def _pair(key: tuple, queries: pd.DataFrame, bucket: pd.DataFrame, k: int, focus: int) -> pd.DataFrame:
    """The k best candidates of a bucket for each query of a block, after local pruning."""
    out_q, out_id, out_s = [], [], []
    if len(queries) and len(bucket):
        bucket = bucket.sort_values(["norm", "id"], ascending=[False, True], kind="stable")
        c = np.frombuffer(b"".join(bucket["packed"]), "<i8").reshape(len(bucket), -1)
        norms, ids = bucket["norm"].to_numpy(), bucket["id"].to_numpy()
        q = np.frombuffer(b"".join(queries["packed"]), "<i8").reshape(len(queries), -1)
        lengths, floors, own = queries["norm"].to_numpy(), queries["floor"].to_numpy(float), queries["id"].to_numpy()
        # the bound is kept strictly below what rounding could hide
        reach = lengths * norms[0] * (1 + 1e-9) + 1
        open_rows = np.flatnonzero(~(reach < floors))
        fits = lengths.max(initial=0) * norms[0] < _EXACT
        cf = c.astype(np.float64) if fits else None
        for i in open_rows:
            with np.errstate(divide="ignore", invalid="ignore"):
                local = floors[i] / (lengths[i] * norms[0])
            # length pruning: candidates in order of norm, only a prefix can reach the floor
            alive = int(np.searchsorted(-(norms * lengths[i] * (1 + 1e-9) + 1), -floors[i], side="right")) if np.isfinite(floors[i]) else len(norms)
            rows = slice(0, alive)
            chosen = np.arange(alive)
            if fits and np.isfinite(local) and local > 0.6 and q.shape[1] > 2 * focus:
                # coordinate pruning: exact part on the query's largest coordinates, the rest bounded
                top = np.argsort(-np.abs(q[i]))[:focus]
                part = cf[rows][:, top]
                rest_q = np.sqrt(max(lengths[i] ** 2 - float((q[i][top].astype(float) ** 2).sum()), 0.0))
                rest_c = np.sqrt(np.maximum(norms[rows] ** 2 - (part**2).sum(axis=1), 0.0))
                most = part @ q[i][top].astype(float) + rest_q * rest_c * (1 + 1e-9) + 1
                chosen = np.flatnonzero(most >= floors[i])
            if not len(chosen):
                continue
            score = (cf[chosen] @ q[i].astype(np.float64)).astype(np.int64) if fits else _products(q[i : i + 1], c[chosen], np.inf)[0]
            s, found = _best(score, ids[chosen], own[i], k)
            out_q.append(np.full(len(s), own[i]))
            out_id.append(found)
            out_s.append(s)
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_id, out_s)]
    return pd.DataFrame({"query_id": flat[0], "id": flat[1], "score": flat[2]})


def top_k(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_every: int = 100,
    k: int = 10,
    scale: float = 1024.0,
    focus: int = 8,
) -> DataFrame:
    """[query_id, rank, id, score]: the k highest integer products of every query.

    Components become floor(scale * x). Queries are the rows whose id is divisible by
    ``query_every``; a query never meets rows of its own id. All candidates count, nothing is
    capped: pruning only skips products that a proven bound keeps out of the result.

    Defined cases: vectors that are null, or hold null or non-finite components, and rows with
    a null id take no part; vectors of another number of components aren't candidates; the zero
    vector scores 0; ties go to the smaller id; repeated rows of one id count once (the largest
    score); fewer than k candidates give fewer ranks; an empty table gives an empty result.
    Scores beyond a long are clamped to its range.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = materialise(base.mapInArrow(partial(_integers, scale=scale), "id bigint, dims int, norm double, packed binary"), "vectors")
    total = rows.count()
    if total == 0:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")

    # norm ranges from quantiles (their number follows the table), salted where one holds too many
    wanted = max(1, -(-total // BUCKET_ROWS))
    cuts = sorted(set(rows.approxQuantile("norm", [i / min(wanted, 1000) for i in range(1, min(wanted, 1000))], 0.001))) if wanted > 1 else []
    edges = F.array(*[F.lit(float(x)) for x in cuts]) if cuts else F.array().cast("array<double>")
    ranged = rows.withColumn("range", F.size(F.filter(edges, lambda e: e < F.col("norm"))))
    counts = ranged.groupBy("dims", "range").agg(F.count("*").alias("n"))
    # at most 1000 ranges a vector width
    ranged = ranged.join(counts.hint("merge"), ["dims", "range"])
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BUCKET_ROWS))
    placed = materialise(ranged.select("dims", "range", salt.alias("salt"), "id", "norm", "packed"), "norm-buckets")

    is_query = F.pmod("id", F.lit(query_every)) == 0
    n_query = placed.where(is_query).count()
    blocks = max(1, -(-n_query // BLOCK_ROWS))
    queries = materialise(placed.where(is_query).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))), "query-blocks")

    buckets = materialise(placed.groupBy("dims", "range", "salt").agg(F.count("*").alias("n"), F.max("norm").alias("longest")), "bucket-list")
    # the first pass visits enough of the longest buckets to give every query k candidates
    order = Window.partitionBy("dims").orderBy(F.desc("longest"), "range", "salt")
    seen = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("first", seen <= k)

    def search(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        keys = ["dims", "block", "range", "salt"]
        own = asked.select("dims", "block", "id", "norm", "packed", "floor")
        left = own.join(pairs.select(*keys).hint("merge"), ["dims", "block"]).select(*keys, "id", "norm", "packed", "floor")
        right = placed.join(pairs.select(*keys).hint("merge"), ["dims", "range", "salt"]).select(*[F.col(c).alias(c) for c in (*keys, "id", "norm", "packed")])
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(partial(_pair, k=k, focus=focus), "query_id bigint, id bigint, score bigint")
        return found

    def merged(found: DataFrame) -> DataFrame:
        single = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return single.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    # one width of vectors may hold all buckets: they are dealt to lanes, and every lane meets all blocks in a task of its own
    lanes = max(1, -(-buckets.count() // LANE_BUCKETS))
    buckets = buckets.withColumn("lane", F.pmod(F.xxhash64("range", "salt"), F.lit(lanes)).cast("int"))

    def in_lanes(asked: DataFrame) -> DataFrame:
        return asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    block_list = queries.groupBy("dims", "block").agg(F.max("norm").alias("reach"))
    first_pairs = in_lanes(block_list).join(buckets.where("first").hint("merge"), ["dims", "lane"])
    unbounded = queries.withColumn("floor", F.lit(float("-inf")))
    start = materialise(search(first_pairs, unbounded), "first-pass")
    floors = merged(start).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    bounded = materialise(queries.join(floors.hint("merge"), "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "queries")

    # a pair of block and bucket is worth building if some query of the block can reach its floor there
    norm = F.when(F.col("norm") > 0, F.col("norm")).otherwise(F.lit(1e-9))
    need = bounded.groupBy("dims", "block").agg(F.min(F.col("floor") / norm).alias("need"))
    pairs = in_lanes(need).join(buckets.where("NOT first").hint("merge"), ["dims", "lane"]).where("NOT (longest * (1 + 1e-9) + 1 < need)")
    rest = search(pairs, bounded)
    return merged(start.unionByName(rest)).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def op9_top_k(spark, sf_dir: str) -> DataFrame:
    """The 10 best products of every hundredth vector: [query_id, rank, vec_id, score]."""
    found = top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumnRenamed("id", "vec_id").select("query_id", "rank", "vec_id", "score")


ORACLE = {
    "op9_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
}

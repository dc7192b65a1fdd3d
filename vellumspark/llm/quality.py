"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; the unlabelled set is the corpus itself.
Labels of quality 0 are not used. A linear model over text statistics minimises the
non-negative unbiased risk ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the
logistic loss.

The statistics of every whole text are computed once and written; all that follows reads that
table. Means and deviations of the features, and the score tails that give the class prior, are
aggregates over all documents. The prior comes from a first model that separates positives from
unlabelled rows: it is the least ratio of upper-tail frequencies (unlabelled over positive),
which regions of the score that hold only positives attain. Only the two descents take bounded samples
(``max_rows`` each, lowest hashes of the id first): a documented limit of the fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm import textblock as tb
from vellumspark.llm import textstats as ts
from vellumspark.session import lowest_hashes, materialise, ship

#: Standardised features are cut to this size.
_CLIP = 8.0
#: Bins of the score histograms that give the class prior.
_BINS = 2000


def features(block: tb.Block) -> np.ndarray:
    """(texts x features) statistics of whole texts; an empty text has zeros."""
    base = ts.base_counts(block)
    kinds = base["kinds"].astype(float)
    chars = np.maximum(kinds.sum(axis=1), 1)
    n = base["n_words"].astype(float)
    words, owner = base["words"], base["owner"]
    some = np.maximum(n, 1)
    ordered = tb.sort_each(words, tb.bounds_of(owner, block.n))
    distinct = np.bincount(owner[tb.runs(ordered, owner) == 0], minlength=block.n)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    adjacent = np.bincount(owner[same], minlength=block.n)
    shouted = (base["upper"] * 2 > base["size"]) & (base["size"] > 1)
    shouting = np.bincount(owner[shouted], minlength=block.n)
    lines = np.maximum(base["n_lines"], 1)
    columns = [
        np.log1p(n),
        base["word_chars"] / some,
        distinct / some,
        np.log1p(n) * distinct / some,
        adjacent / some,
        shouting / some,
        base["n_symbols"] / some,
        base["n_dup_lines"] / lines,
        base["n_repeat_words"] / some,
        np.log1p(n / lines),
        (n < 20).astype(float),
    ]
    shares = kinds / chars[:, None]
    # squares let the linear model prefer middle values; roots spread out small shares
    return np.column_stack([*columns, columns[1] ** 2, columns[0] ** 2, shares, np.sqrt(shares)])


#: Number of features.
WIDTH = 13 + 2 * len(ts.CLASSES)


@tb.tidied
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) -> (row, features), block by block."""
    for batch in batches:
        for block in tb.blocks(batch.column(1)):
            x = features(block)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), flat], ["row", "features"])


def with_features(docs: DataFrame, keep: str = "*") -> DataFrame:
    """[row, features] of every row; ``row`` is a struct of the kept columns, whatever their names."""
    ship(docs.sparkSession)
    rows = docs.select(F.struct(keep).alias("row"), F.col("text").alias("text"))
    return rows.mapInArrow(_extract, f"row {dict(rows.dtypes)['row']}, features array<double>")


def _descend(xp: np.ndarray, xu: np.ndarray, prior: float | None, steps: int, decay: float) -> np.ndarray:
    """Weights (last: intercept) by full-batch Adam; no prior: plain positive-against-unlabelled."""
    xp, xu = (np.column_stack([x, np.ones(len(x))]) for x in (xp, xu))
    w = np.zeros(xp.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)

    def slope(x: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
        z = sign * (x @ w)
        return float(np.logaddexp(0, -z).mean()), -(sign / (1 + np.exp(np.clip(z, -500, 500)))) @ x / len(x)

    for step in range(1, steps + 1):
        _, plus = slope(xp, 1)
        unlabelled, minus_u = slope(xu, -1)
        if prior is None:
            g = (plus + minus_u) / 2
        else:
            as_negative, minus_p = slope(xp, -1)
            risk = unlabelled - prior * as_negative
            # a negative empirical risk of the negatives means overfitting: step back on that part
            g = prior * plus + (minus_u - prior * minus_p) if risk >= 0 else -(minus_u - prior * minus_p)
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows from two score histograms (counts by ascending bin)."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    if not n_p or not n_u:
        return 1.0
    tail_p, tail_u = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (positive, unlabelled))
    # tails of at least a tenth of the positives: smaller ones are too noisy
    some = (tail_p >= 0.1) & (tail_p <= 0.99)
    if not some.any():
        return float(np.clip(1.0, 0.05, 0.98))
    slack = np.sqrt(1 / n_p) + np.sqrt(1 / n_u)
    best = np.flatnonzero(some)[int(np.argmin((tail_u[some] + slack) / tail_p[some]))]
    return float(np.clip(tail_u[best] / tail_p[best], 0.05, 0.98))


def logit(features: str, model: dict) -> Column:
    """The linear model's value of the feature array in a column."""
    terms = [f"least(greatest(({features}[{i}] - ({m}D)) / {s}D, -{_CLIP}D), {_CLIP}D) * ({w}D)" for i, (m, s, w) in enumerate(zip(model["mean"], model["scale"], model["weights"][:-1], strict=True))]
    return F.expr(" + ".join([f"({float(model['weights'][-1])}D)", *terms]))


def chance(features: str, model: dict) -> Column:
    """Probability of good quality, 0 to 1."""
    return 1 / (1 + F.exp(-F.least(F.greatest(logit(features, model), F.lit(-500.0)), F.lit(500.0))))


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(table: DataFrame, labels: DataFrame, max_rows: int = 8000, steps: int = 400, decay: float = 1e-4) -> dict:
    """The model {mean, scale, weights (last: intercept), prior} from a written table [id, features].

    Learns from rows outside the held-out fold (crc32(id as text) mod 5 = 0). Neither labels, lang,
    source nor ids are inputs of a score. ``max_rows`` bounds each of the two samples of the
    descents. Of rows that share an id the one with the smallest features counts. Without
    positives the model scores 1 everywhere.
    """
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id")).distinct().withColumn("trusted", F.lit(True))
    single = table.where(F.col("id").isNotNull() & (_fold(F.col("id")) != 0)).groupBy("id").agg(F.min("features").alias("features"))
    marked = single.join(trusted.hint("merge"), "id", "left").select("id", "features", F.coalesce("trusted", F.lit(False)).alias("trusted"), (_fold(F.col("id")) <= 2).alias("first"))
    marked = materialise(marked, "quality-rows")
    samples = [lowest_hashes(rows, "id", max_rows, seed).toPandas() for rows, seed in ((marked.where("trusted"), 42), (marked, 7))]  # at most max_rows each
    if min(map(len, samples)) < 4:
        return {"mean": [], "scale": [], "weights": [20.0], "prior": 1.0}
    stats = table.agg(*[F.expr(f"{f}(features[{i}]) AS {k}{i}") for i in range(WIDTH) for k, f in (("m", "avg"), ("s", "stddev_pop"))]).first()
    mean, scale = np.array([stats[f"m{i}"] for i in range(WIDTH)]), np.array([stats[f"s{i}"] for i in range(WIDTH)]) + 1e-6
    xp, xu = (np.clip((np.array(x["features"].tolist(), float) - mean) / scale, -_CLIP, _CLIP) for x in samples)
    model = {"mean": mean.tolist(), "scale": scale.tolist()}
    # the first model learns from some of the ids; the tails are those of all the others
    own_p, own_u = (x["first"].to_numpy(bool) for x in samples)
    first = model | {"weights": _descend(xp[own_p], xu[own_u], None, steps, decay).tolist()}
    bins = marked.where("NOT first").select("trusted", F.least(F.floor(chance("features", first) * _BINS), F.lit(_BINS - 1)).alias("bin"))
    histograms = np.zeros((2, _BINS))
    for r in bins.groupBy("bin").agg(F.count_if("trusted").alias("p"), F.count("*").alias("n")).collect():  # at most _BINS rows
        histograms[:, r["bin"]] = r["p"], r["n"]
    prior = class_prior(*histograms)
    return model | {"weights": _descend(xp, xu, prior, steps, decay).tolist(), "prior": prior}


def _judged(docs: DataFrame, labels: DataFrame, keep: str, **options) -> DataFrame:
    """[row, quality] of every row, from one pass over the texts."""
    table = materialise(with_features(docs, keep), "quality-features")
    model = fit(table.select(F.col("row.doc_id").alias("id"), "features"), labels, **options)
    return table.select("row", chance("features", model).alias("quality"))


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with quality_score (0 to 1, higher: better) in place of a column of that name.

    Defined cases: null and empty texts are scored as empty texts; rows with a null doc_id are
    scored but never trained on; without labelled positives every score is near 1; repeated
    rows get equal scores; an empty table gives an empty result.
    """
    own = [F.col("row")[c].alias(c) for c in docs.columns if c != "quality_score"]
    return _judged(docs, labels, "*", **options).select(*own, F.col("quality").alias("quality_score"))


def quality_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Documents whose score reaches the threshold; columns unchanged, whatever their names.

    Defined cases as in :func:`score`; without labelled positives every document is kept.
    """
    return _judged(docs, labels, "*", **options).where(F.col("quality") >= threshold).select("row.*")


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document: [doc_id, held_out, score, predicted]."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = _judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    doc_id = F.col("row.doc_id")
    return judged.select(
        doc_id.alias("doc_id"),
        (_fold(doc_id) == 0).alias("held_out"),
        F.col("quality").alias("score"),
        (F.col("quality") >= 0.3).cast("int").alias("predicted"),
    )

"""Toxicity by classifier chains over sparse word features.

The chain predicts its categories in order; every link is a logistic regression on the words
of a text and on the probabilities of the earlier links. While training, a link sees the
earlier links' out-of-fold probabilities (models fitted on the other folds), so it learns how
far they can be trusted on texts they have not seen. The last link is ``toxic``.

The categories before it are label columns, where there are any. Where the labels hold the
column ``toxic`` alone, the categories are kinds of toxic rows found in the data: the toxic
training rows are grouped by the words that set them apart from the others (spherical k-means),
and a kind is the rows of a group, the largest group first.

The fit uses at most ``max_rows`` labelled rows of each class; the vocabulary is the words of
those rows with a significant positive association with toxicity (chi-square of ``min_chi`` or
more, in ``min_rows`` rows or more). Scoring covers every whole text: presence of words, whatever the length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm import textblock as tb
from vellumspark.llm import textstats as ts
from vellumspark.session import lowest_hashes, materialise, ship

TOXIC = "toxic"


@tb.tidied
def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, labels, text) -> distinct word hashes and a content fold."""
    for batch in batches:
        for block in tb.blocks(batch.column(2)):
            h, owner = ts.bare_words(block)
            at = tb.bounds_of(owner, block.n)
            sets = [np.unique(h[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            fold = [int(s.sum(dtype=np.uint64) % np.uint64(3)) for s in sets]
            given = [batch.column(i).slice(block.first, block.n) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*given, pa.array(fold, pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "labels", "fold", "words"])


class _Sparse:
    """Rows of present features, with dense columns beside them."""

    def __init__(self, row: np.ndarray, col: np.ndarray, n: int, width: int, dense: np.ndarray):
        self.row, self.col, self.n, self.width, self.dense = row, col, n, width, dense

    def dot(self, w: np.ndarray) -> np.ndarray:
        z = np.bincount(self.row, w[self.col], minlength=self.n) if len(self.row) else np.zeros(self.n)
        return z + self.dense @ w[self.width : -1] + w[-1]

    def slope(self, r: np.ndarray) -> np.ndarray:
        words = np.bincount(self.col, r[self.row], minlength=self.width) if len(self.row) else np.zeros(self.width)
        return np.concatenate([words, r @ self.dense, [r.sum()]]) / self.n

    def rows(self, keep: np.ndarray) -> _Sparse:
        number = np.cumsum(keep) - 1
        some = keep[self.row]
        return _Sparse(number[self.row[some]], self.col[some], int(keep.sum()), self.width, self.dense[keep])


def _logistic(x: _Sparse, y: np.ndarray, steps: int = 200, decay: float = 2e-4) -> np.ndarray:
    w = np.zeros(x.width + x.dense.shape[1] + 1)
    if x.n == 0 or y.min() == y.max():
        w[-1] = 20.0 if x.n and y.min() else -20.0
        return w
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = x.slope(_sigmoid(x.dot(w)) - y) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_chain(x: _Sparse, targets: dict[str, np.ndarray], fold: np.ndarray) -> dict[str, list[float]]:
    """Weights by category; later links are trained on out-of-fold probabilities of earlier ones."""
    model, dense = {}, np.zeros((x.n, 0))
    for name, y in targets.items():
        link = _Sparse(x.row, x.col, x.n, x.width, dense)
        out = np.zeros(x.n)
        for f in np.unique(fold):
            away, own = fold != f, fold == f
            out[own] = _sigmoid(link.rows(own).dot(_logistic(link.rows(away), y[away])))
        model[name] = _logistic(link, y).tolist()
        dense = np.column_stack([dense, out])
    return model


def kinds(row: np.ndarray, col: np.ndarray, n: int, weight: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Group (0: the largest) of each of n rows of present, weighted features, by spherical k-means.

    A group starts as the rows of one word: the heaviest one, by its rows, among the rows that no group has yet.
    """
    value = weight[col]
    length = np.sqrt(np.bincount(row, value**2, minlength=n))
    value = value / np.maximum(length[row], 1e-12)

    def alike(centre: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * centre[col], minlength=n) / max(float(np.sqrt((centre**2).sum())), 1e-12)

    centres, left = [], np.ones(n, bool)
    for _ in range(k):
        word = int(np.argmax(np.bincount(col[left[row]], value[left[row]], minlength=len(weight)))) if len(weight) else 0
        mine = np.zeros(n, bool)
        mine[row[(col == word) & left[row]]] = True
        centres.append(np.bincount(col[mine[row]], value[mine[row]], minlength=len(weight)))
        left &= ~mine
    group = np.zeros(n, int)
    for step in range(rounds):
        new = np.argmax([alike(c) for c in centres], axis=0)
        if step and (new == group).all():
            break
        group = new
        centres = [np.bincount(col, np.where(group[row] == g, value, 0.0), minlength=len(weight)) for g in range(k)]
    order = np.argsort(-np.bincount(group, minlength=k), kind="stable")
    return np.argsort(order)[group]


def train(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str] | int = 2,
    max_rows: int = 3000,
    min_rows: int = 3,
    min_chi: float = 10.8,
) -> dict:
    """Fit the chain {words, links} on a bounded sample: at most ``max_rows`` labelled rows of each class.

    ``categories``: label columns (0 or 1) that come before ``toxic``, or a number of kinds of
    toxic rows to find. Of rows that share an id the one with the smallest text counts.
    """
    ship(docs.sparkSession)
    named = [] if isinstance(categories, int) else list(categories)
    flags = F.array(*[F.max(F.coalesce(F.col(c), F.lit(0)).cast("int")) for c in (*named, TOXIC)]).alias("labels")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(TOXIC).isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(flags)
    own = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text")).where("id IS NOT NULL")
    known = materialise(known.join(own.select("id").distinct().hint("merge"), "id", "left_semi"), "toxicity-labels")
    last = F.element_at("labels", -1)
    # at most 2 * max_rows ids: bounded by the parameter
    chosen = lowest_hashes(known.where(last == 1), "id", max_rows).unionByName(lowest_hashes(known.where(last == 0), "id", max_rows))
    single = own.join(F.broadcast(chosen), "id").groupBy("id", "labels").agg(F.min("text").alias("text"))
    rows = materialise(single.mapInArrow(_present, f"id {dict(own.dtypes)['id']}, labels array<int>, fold int, words array<bigint>"), "toxicity-sample")

    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum(last), F.lit(0))).first()
    counts = rows.select(last.alias(TOXIC), F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"), F.sum(TOXIC).alias("hits"))
    expected = F.col("df") * F.lit(pos / max(n, 1))
    chi = (F.col("hits") - expected) ** 2 / F.greatest(expected, F.lit(1e-9))
    # words that speak for toxicity; one without any of them gets the intercept's low probability
    top = counts.select("word", "df", "hits", chi.alias("chi"), expected.alias("expected")).where((F.col("df") >= min_rows) & (F.col("hits") > F.col("expected")) & (F.col("chi") >= min_chi))
    top = materialise(top.select("word", "chi"), "toxicity-words")  # bounded by the sample
    pairs = rows.select("id", F.explode("words").alias("word")).join(F.broadcast(top), "word").groupBy("id").agg(F.collect_list("word").alias("present"))
    sample = rows.select("id", "labels", "fold").join(pairs.hint("merge"), "id", "left").toPandas().sort_values("id", ignore_index=True)
    listed = top.toPandas().sort_values("word", ignore_index=True)

    vocabulary = listed["word"].to_numpy(np.int64)
    found = [np.searchsorted(vocabulary, np.asarray(w, np.int64)) if w is not None else np.zeros(0, np.int64) for w in sample["present"]]
    row = np.repeat(np.arange(len(found)), [len(c) for c in found]).astype(int)
    col = np.concatenate(found).astype(int) if len(found) else np.zeros(0, int)
    marked = np.array(sample["labels"].tolist(), float).reshape(len(sample), len(named) + 1)
    toxic = marked[:, -1]
    targets = {c: marked[:, i] for i, c in enumerate(named)}
    if not named and categories:
        bad = np.flatnonzero(toxic == 1)
        inside = np.isin(row, bad)
        group = kinds(np.searchsorted(bad, row[inside]), col[inside], len(bad), listed["chi"].to_numpy(float), int(categories)) if len(bad) else np.zeros(0, int)
        for g in range(int(categories)):
            targets[f"kind_{g + 1}"] = np.zeros(len(sample))
            targets[f"kind_{g + 1}"][bad[group == g]] = 1.0
    x = _Sparse(row, col, len(sample), len(vocabulary), np.zeros((len(sample), 0)))
    return {"words": vocabulary.tolist(), "links": fit_chain(x, targets | {TOXIC: toxic}, sample["fold"].to_numpy())}


@tb.tidied
def _score(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    """(row, text) -> (row, probability of every link), block by block."""
    given = json.loads(model)
    signed = np.array(given["words"], np.int64)
    links = [np.array(w) for w in given["links"].values()]
    by = np.argsort(signed.view(np.uint64))
    vocabulary = signed.view(np.uint64)[by]
    for batch in batches:
        for block in tb.blocks(batch.column(1)):
            h, owner = ts.bare_words(block)
            if len(vocabulary):
                spot = np.searchsorted(vocabulary, h)
                spot[spot == len(vocabulary)] = 0
                hit = vocabulary[spot] == h
                pair = np.unique(owner[hit] * len(vocabulary) + by[spot[hit]])
                row, col = pair // len(vocabulary), pair % len(vocabulary)
            else:
                row = col = np.zeros(0, int)
            dense = np.zeros((block.n, 0))
            for w in links:
                dense = np.column_stack([dense, _sigmoid(_Sparse(row, col, block.n, len(vocabulary), dense).dot(w))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), *[pa.array(dense[:, i]) for i in range(len(links))]], ["row", *[f"p{i}" for i in range(len(links))]])


def _judged(docs: DataFrame, model: dict, keep: str = "*") -> DataFrame:
    """[row, p0, p1, ..]: the kept columns as a struct, whatever their names, and every link's probability."""
    ship(docs.sparkSession)
    rows = docs.select(F.struct(keep).alias("row"), F.col("text").alias("text"))
    fields = ", ".join(f"p{i} double" for i in range(len(model["links"])))
    return rows.mapInArrow(partial(_score, model=json.dumps(model)), f"row {dict(rows.dtypes)['row']}, {fields}")


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with p_<category> of every link, in place of columns of these names; the last, p_toxic, is the verdict's probability.

    Defined cases: null and empty texts have no words and get the intercept's probability;
    repeated rows get equal scores; an empty table gives an empty result.
    """
    added = [f"p_{c}" for c in model["links"]]
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in added]
    return _judged(docs, model).select(*own, *[F.col(f"p{i}").alias(c) for i, c in enumerate(added)])


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """Documents whose toxicity stays below the threshold; columns unchanged, whatever their names.

    Defined cases as in :func:`score`; rows with a null doc_id are scored but never trained on;
    without labelled toxic rows nothing is rejected.
    """
    model = train(docs, labels, **options)
    return _judged(docs, model).where(F.col(f"p{len(model['links']) - 1}") < threshold).select("row.*")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Probabilities and verdict of every document: [doc_id, p_kind_1, p_kind_2, score, toxic]."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = _judged(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "doc_id")
    return judged.select("row.doc_id", F.col("p0").alias("p_kind_1"), F.col("p1").alias("p_kind_2"), F.col("p2").alias("score"), (F.col("p2") >= 0.3).alias("toxic"))

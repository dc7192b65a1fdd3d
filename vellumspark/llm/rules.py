"""Quality rules: base counts, and the divergence of a text from its language's histograms.

A text is compared with its language's reference in two histograms: character classes, and
common words (each word of a short list of the language's function words, and the rest). The
references are means over all documents of the corpus that pass the base rules. A text whose
Jensen-Shannon distance (base 2, 0 to 1) is above a limit is rejected; texts under the
minimum lengths are not compared, as short histograms diverge by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm import textblock as tb
from vellumspark.llm import textstats as ts
from vellumspark.session import materialise, ship

#: Common function words by language; a parameter of the operator.
COMMON_WORDS = {
    "en": "the of and to in is that it for was with as on be by at this are from or an".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par sur au ce il avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo".split(),
}


@tb.tidied
def _counts(batches: Iterator[pa.RecordBatch], words: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
    width = max(len(w) for w in words.values())
    order = {}
    for lang, own in words.items():
        h = ts.word_hash(own)
        by = np.argsort(h)
        order[lang] = (h[by], by)
    for batch in batches:
        for block in tb.blocks(batch.column(1)):
            ids, langs = batch.column(0).slice(block.first, block.n), batch.column(2).slice(block.first, block.n)
            base = ts.base_counts(block)
            common = np.zeros((block.n, width + 1), np.int64)
            which = np.array([x if x in order else "" for x in langs.to_pylist()], object)
            bare, owner = ts.bare_words(block)
            for lang, (h, by) in order.items():
                mine = np.flatnonzero((which == lang)[owner])
                spot = np.searchsorted(h, bare[mine])
                spot[spot == len(h)] = 0
                hit = h[spot] == bare[mine]
                flat = owner[mine[hit]] * (width + 1) + by[spot[hit]]
                common += np.bincount(flat, minlength=block.n * (width + 1)).reshape(block.n, -1)
            common[:, width] = base["n_words"] - common.sum(axis=1)
            kinds = base["kinds"]

            def nested(x: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))

            fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(base[c].astype(np.int64)) for c in fields], pa.array([x or None for x in which], pa.string()), nested(kinds), nested(common)],
                ["doc_id", *fields, "known_lang", "kinds", "common"],
            )


def _share(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(counts, lambda x: x / F.when(total > 0, total).otherwise(1.0))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    halves = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(halves, F.lit(0.0), lambda s, x: s + x) / 2))


def quality_rules(
    docs: DataFrame,
    words: dict[str, list[str]] | None = None,
    min_words: int = 20,
    max_repeat: float = 0.3,
    compare_chars: int = 200,
    compare_words: int = 60,
    char_limit: float = 0.2,
    word_limit: float = 0.3,
) -> DataFrame:
    """[doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    char_distance, word_distance, kept] of every row.

    Defined cases: a null text counts as empty and fails the base rules; a null or unlisted
    language is compared with the mean of all such texts in character classes only; below
    ``compare_chars`` word characters, or ``compare_words`` words, the distance is null and
    does not reject; repeated rows are judged each; a null doc_id is kept as null; an empty
    table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    words = words or COMMON_WORDS
    schema = (
        f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, known_lang string, kinds array<bigint>, common array<bigint>"
    )
    counted = docs.select("doc_id", "text", "lang").mapInArrow(partial(_counts, words=words), schema)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    counted = materialise(counted.withColumns({"base_failed": failed, "kinds": _share(F.col("kinds")), "common": _share(F.col("common"))}), "rule-counts")

    long_enough = (~F.col("base_failed")) & (F.col("word_chars") >= compare_chars) & (F.col("n_words") >= compare_words)
    n_kinds, n_common = len(ts.CLASSES), max(len(w) for w in words.values()) + 1
    means = counted.where(long_enough).groupBy("known_lang").agg(
        F.array(*[F.avg(F.col("kinds")[i]) for i in range(n_kinds)]).alias("ref_kinds"),
        F.array(*[F.avg(F.col("common")[i]) for i in range(n_common)]).alias("ref_common"),
    )
    # one row per listed language and one for the rest: bounded by the parameter
    judged = counted.join(F.broadcast(means), counted["known_lang"].eqNullSafe(means["known_lang"]), "left").drop(means["known_lang"])
    judged = judged.withColumns(
        {
            "char_distance": F.when(F.col("word_chars") >= compare_chars, _distance(F.col("kinds"), F.col("ref_kinds"))),
            "word_distance": F.when(F.col("known_lang").isNotNull() & (F.col("n_words") >= compare_words), _distance(F.col("common"), F.col("ref_common"))),
        }
    )
    diverges = (F.coalesce("char_distance", F.lit(0.0)) > char_limit) | (F.coalesce("word_distance", F.lit(0.0)) > word_limit)
    return judged.withColumn("kept", ~F.col("base_failed") & ~diverges).select(
        "doc_id", "known_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    judged = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    distances = [F.round(c, 6).alias(c) for c in ("char_distance", "word_distance")]
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *distances)


def _oracle() -> str:
    """The same counts and distances as SQL; classes and words in the order of the module's tables."""
    classes = [
        "[a-z]", "[A-Z]", "[0-9]", r"[ \t]", r"[\n\x0b\x0c\r]", "[.,;:]", "[!?]", r"['\"()\-_/]", r"[#*$%&|<>@^~+=\\{}\[\]`]", r"[\x{80}-\x{27f}]", r"[\x{280}-\x{10ffff}]",
        r"[\x00-\x08\x0e-\x1f\x7f]",
    ]
    quoted = [c.replace("'", "''") for c in classes]
    kinds = ", ".join(f"length(text) - length(regexp_replace(text, '{c}', '', 'g'))" for c in quoted)
    width = max(len(w) for w in COMMON_WORDS.values())
    lists = ", ".join(f"('{lang}', {[*own, *[''] * (width - len(own))]})" for lang, own in COMMON_WORDS.items())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    mark = r"[!-/:-@\[-`{-~]"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({", ".join(f"'{x}'" for x in COMMON_WORDS)}) THEN lang END AS lang FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) AS s FROM w WHERE len(w) > 8),
g0 AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM g),
g1 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g0),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g1 WHERE c > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  [{kinds}] AS kinds, list_transform(w, lambda x: regexp_replace(translate(x, '{upper}', '{lower}'), '^{mark}+|{mark}+$', '', 'g')) AS bare
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
words(lang, list) AS (VALUES {lists}),
cw AS (SELECT doc_id, f.lang, n_words, list_transform(list, lambda y: CASE WHEN y = '' THEN 0 ELSE len(list_filter(bare, lambda x: x = y)) END) AS c FROM f JOIN words ON f.lang = words.lang),
parts AS (SELECT doc_id, lang, 'k' AS part, unnest(range(12)) AS spot, unnest(kinds)::DOUBLE / greatest(list_sum(kinds), 1) AS x FROM f
  UNION ALL SELECT doc_id, lang, 'w', unnest(range({width + 1})), unnest(list_append(c, n_words - list_sum(c)))::DOUBLE / greatest(n_words, 1) FROM cw),
ok AS (SELECT doc_id FROM f WHERE NOT base_failed AND word_chars >= 200 AND n_words >= 60),
ref AS (SELECT lang, part, spot, avg(x) AS y FROM parts WHERE doc_id IN (SELECT doc_id FROM ok) GROUP BY ALL),
js AS (SELECT doc_id, parts.part, sqrt(greatest(0, sum((CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END) + (CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END)) / 2)) AS d
  FROM parts JOIN ref ON parts.lang IS NOT DISTINCT FROM ref.lang AND parts.part = ref.part AND parts.spot = ref.spot GROUP BY ALL),
v AS (SELECT f.*, CASE WHEN word_chars >= 200 THEN k.d END AS kd, CASE WHEN n_words >= 60 THEN m.d END AS wd FROM f
  LEFT JOIN js k ON k.doc_id = f.doc_id AND k.part = 'k' LEFT JOIN js m ON m.doc_id = f.doc_id AND m.part = 'w')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(kd, 0) > 0.2 OR coalesce(wd, 0) > 0.3) AS kept,
  round(kd, 6) AS char_distance, round(wd, 6) AS word_distance FROM v
"""


ORACLE = {"op10_quality_rules": _oracle()}

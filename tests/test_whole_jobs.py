"""Queries that must take all of their input: nothing cut off, thinned out or left out."""

import random

from pyspark.sql import functions as F

from vellumspark.operators import notes as no
from vellumspark.operators import search as se
from vellumspark.plans import extraction, records, trees
from vellumspark.session import table


def test_layout_holds_every_character(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    expected = {r.document_id: "".join((r.text or "").split()) for r in docs.collect()}
    pages = records.QUERIES["p8_reading_order"](spark, sf).toPandas().sort_values(["document_id", "page", "token_no"])
    found = pages.groupby("document_id").text.agg("".join).to_dict()
    assert found == {d: t for d, t in expected.items() if t} and pages.page.max() > 1
    assert pages.groupby(["document_id", "page"]).size().max() <= 1000
    words = records.QUERIES["p9_page_text"](spark, sf).toPandas()
    assert len(words[words.page > 1]) and sum(len("".join(t.split())) for t in words.text) > sum(map(len, found.values()))


def test_phrases_with_repeated_words(spark):
    texts = ["from New York, New Jersey", "new york jersey", "to be or not to be", "to be or not", "that that", "that", "a b a a b"]
    tokens = se.tokenise(spark.createDataFrame([("d", str(i), t) for i, t in enumerate(texts)], "document_id string, block_id string, text string"))
    found = lambda phrase: sorted(int(r.block_id) for r in se.match_phrase(tokens, phrase).collect())
    assert found("new york new jersey") == [0] and found("to be or not to be") == [2] and found("that that") == [4]
    assert found("a b a") == [6] and found("b a b") == [] and found("york new") == [0] and found("!") == []


def _loose_anchor(note, blocks):
    """The reference's passes after the strict one, block by block; ASCII texts, so bytes are characters."""
    _, _, words, prefix, suffix, offset = note
    needle, p, s = words.strip().lower(), prefix.strip(), suffix.strip()
    best = None
    for block, text in blocks:
        low = text.lower()
        for i in (i for i in range(len(low)) if low.startswith(needle, i)):
            left, right = low[max(0, i - len(prefix)) : i], low[i + len(needle) :][: len(suffix)]
            score = 0.4
            if p and left and (p.lower()[-10:] in left or left[-10:] in p.lower()):
                score += 0.2
            if s and right and (s.lower()[:10] in right or right[:10] in s.lower()):
                score += 0.2
            score -= min(0.15, abs(i - offset) / 20000) if offset > 0 else 0
            if best is None or round(score, 9) > round(best[3], 9):
                best = (block, i, i + len(needle), score, "case")
    for block, text in blocks:
        if p and p in text and (best is None or best[3] < 0.4):
            start = text.index(p) + len(p)
            best = (block, start, min(len(text), start + len(needle)), 0.4, "prefix")
    return best and (*best[:3], round(best[3], 6), best[4])


def test_loose_anchors_match_a_loop(spark):
    rng = random.Random(5)
    words = ["ab", "cd", "ef", "gh"]
    blocks, notes = [], []
    for d in range(60):
        own = [(f"{d}-{i}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(3)]
        blocks += [(str(d), b, i, t) for i, (b, t) in enumerate(own)]
        needle = rng.choice(["Cd", "AB", "GH ef", "Absent"])
        notes.append((str(d), f"n{d}", needle, " ".join(rng.choice(words) for _ in range(4)) + " ", " " + " ".join(rng.choice(words) for _ in range(4)), rng.choice([0, 5, 9000])))
    first = "Far off the needle. " * 5
    blocks += [("x", "x-0", 0, first + "the quick needle jumps")]
    notes += [("x", "nx", "NEEDLE", "the quick ", " jumps", 0)]
    schema = "document_id string, annotation_id string, highlighted_text string, prefix string, suffix string, offset int"
    got = no.reanchor_loose(spark.createDataFrame(notes, schema), spark.createDataFrame(blocks, "document_id string, block_id string, sort_order int, text string"))
    found = {r.annotation_id: (r.block_id, r.start, r.end, round(r.confidence, 6), r.mode) for r in got.collect()}
    expected = {n[1]: _loose_anchor(n, [(b, t) for d, b, _, t in blocks if d == n[0]]) for n in notes}
    assert found == {k: v for k, v in expected.items() if v} and {v[4] for v in found.values()} == {"case", "prefix"}
    assert found["nx"] == ("x-0", len(first) + 10, len(first) + 16, 0.8, "case")


def test_loose_query_returns_anchors(spark, sf):
    assert {"annotation_id", "block_id", "start", "end", "confidence", "mode"} == set(trees.QUERIES["d3_reanchor_loose"](spark, sf).columns)


def test_no_row_is_filtered_out(spark, sf):
    repaired = trees.QUERIES["p17_repaired_texts"](spark, sf)
    assert repaired.count() == table(spark, sf, "events").count() and repaired.where("NOT parses").count() > 0
    targets = extraction.QUERIES["v2_cosine_pairs"](spark, sf).select("target_id").distinct().count()
    assert targets == table(spark, sf, "embeddings").where("vec_id % 20 = 0").count()


def test_streaks_are_dealt_by_session(spark, sf, monkeypatch):
    dealt = []
    monkeypatch.setattr(records, "_stream", lambda s, rows, name, make: dealt.append(rows) or rows.select("session_id", "seq", F.lit(0).alias("streak")))
    records.QUERIES["t3_stream_streaks"](spark, sf)
    plan = dealt[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [session_id" in plan and "Repartition 1" not in plan


def test_embeddings_of_blocks_and_stored_vectors(spark, sf):
    blocks = extraction.line_blocks(spark, sf)
    found = extraction.QUERIES["v1_block_embedding"](spark, sf)
    assert found.select("id").distinct().count() == blocks.count() and found.where("value IS NULL").count() == 0
    norms = found.groupBy("id").agg(F.sum(F.col("value") * F.col("value")).alias("n"))
    assert norms.where("abs(n - 1) > 0.001").count() == 0
    assert trees.QUERIES["v8_whole_vectors"](spark, sf).select("dim").distinct().count() > 1


def test_glyph_tokens_are_of_whole_texts(spark, sf):
    expected = {str(r.doc_id): "".join((r.text or "").split()) for r in table(spark, sf, "documents").collect()}
    tokens = records.QUERIES["p7_glyph_tokens"](spark, sf).toPandas().sort_values(["document_id", "page", "token_no"])
    assert tokens.groupby("document_id").text.agg("".join).to_dict() == {d: t for d, t in expected.items() if t}

"""Search texts, nearest vectors, HTML structure, published stores and delta indexes on small cases."""

import re

from pyspark.sql import functions as F

from vellumspark.functions import text as tx
from vellumspark.operators import extract as ex
from vellumspark.operators import postings
from vellumspark.operators import reflow as rf
from vellumspark.operators import search as se
from vellumspark.operators import store as st
from vellumspark.operators import toolog as tl
from vellumspark.streaming import jobs

TEXTS = {
    "a": "to be or not to be", "b": "new york new jersey", "c": "new york city", "d": "the quick brown fox", "e": "the fox, quick and brown", "f": "quicksand and foxes", "g": "NOT a thing OR two", "h": "",
}
BLOCKS = "document_id string, block_id string, text string"


def finds(spark, query):
    blocks = spark.createDataFrame([("x", k, v) for k, v in TEXTS.items()], BLOCKS)
    return {r.block_id for r in se.search(se.tokenise(blocks), query).collect()}


def brute(matches):
    return {k for k, v in TEXTS.items() if matches(" " + " ".join(re.findall(r"\w+", v.lower())) + " ")}


def test_search_text(spark):
    cases = {
        "quick": lambda t: " quick " in t,
        "quick fox": lambda t: " quick " in t and " fox " in t,
        "quick AND fox": lambda t: " quick " in t and " fox " in t,
        "quick*": lambda t: " quick" in t,
        '"quick brown"': lambda t: " quick brown " in t,
        '"new york new"': lambda t: " new york new " in t,
        '"quick br"*': lambda t: " quick br" in t,
        "new NOT city": lambda t: " new " in t and " city " not in t,
        "new NOT city york": lambda t: " new " in t and not (" city " in t and " york " in t),
        "fox NOT the OR foxes": lambda t: (" fox " in t and " the " not in t) or " foxes " in t,
        "be OR jersey OR \"brown fox\"": lambda t: " be " in t or " jersey " in t or " brown fox " in t,
        # these don't read and are searched as phrases
        "fox, quick": lambda t: " fox quick " in t,
        "york OR": lambda t: " york or " in t,
        "NOT a": lambda t: " not a " in t,
        'to be"': lambda t: " to be " in t,
        "": lambda t: False,
        "?!": lambda t: False,
    }
    for query, matches in cases.items():
        assert finds(spark, query) == brute(matches), query


def test_titles_and_cached_vectors(spark):
    blocks = spark.createDataFrame([("x", k, v) for k, v in TEXTS.items()], BLOCKS)
    documents = spark.createDataFrame([("x", "Title"), ("y", "Other")], "id string, title string")
    found = se.search_with_titles(se.tokenise(blocks), blocks, documents, "york city").collect()
    assert [tuple(r) for r in found] == [("c", "new york city", "Title")]
    cache = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 1.0])], "block_id string, vector array<float>")
    assert [(r.document_id, r.id) for r in se.block_vectors(blocks, cache).collect()] == [("x", "a")]


def test_nearest(spark):
    rows = [(i % 2, i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    candidates = spark.createDataFrame(rows, "key int, id int, vector array<double>")
    got = {}
    for r in se.nearest(candidates.where("id < 10"), candidates, "key", 3).collect():
        got.setdefault(r.target_id, []).append((r.rank, r.id))

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)

    scores = {(a[1], b[1]): cosine(a[2], b[2]) for a in rows[:10] for b in rows if a[0] == b[0]}
    for target, ranked in got.items():
        best = sorted((-round(v, 12), i) for (t, i), v in scores.items() if t == target)[:3]
        assert sorted(ranked)[0][0] == 1 and len(ranked) == 3
        assert {round(scores[target, i], 9) for _, i in ranked} == {round(-v, 9) for v, _ in best}
    assert len(got) == 10


def test_html_structure(spark):
    html = "<html><head><title>Test</title></head><body>lead<H2 id='x'>Top</h2><h3></h3><p></p><P>One</p>tail<IMG alt=\"a b\" src='u.png'><table><TR><TH>k</TH></TR><tr></tr></table><table>bare</table><blockquote> q </blockquote><p>open</body>"
    pages = spark.createDataFrame([("d", html)], "document_id string, html string")
    sections = [(r.id, r.title, r.depth_level) for r in ex.html_sections(pages).orderBy("sort_order").collect()]
    assert sections == [("sec-d-default", "Default Section", 1), ("sec-html-d-1", "Top", 2), ("sec-html-d-2", "", 3)]
    blocks = ex.html_structure(pages).orderBy("sort_order").collect()
    assert [r.block_type for r in blocks] == ["paragraph", "heading", "heading", "paragraph", "paragraph", "paragraph", "image", "table", "table", "quote", "paragraph"]
    assert [r.section_id for r in blocks] == ["sec-d-default", "sec-html-d-1"] + ["sec-html-d-2"] * 9
    assert blocks[7].content == '{"type":"table","rows":[{"cells":[{"children":[{"type":"text","text":"k","bold":null,"italic":null,"code":null}],"is_header":true}]}]}'
    assert '"text":"bare"' in blocks[8].content and '"alt":"a b"' in blocks[6].content
    image = ex.html_images(pages).first()
    assert (image.image_id, image.alt, image.local_uri) == ("img-html-1", "a b", f"local-asset://{image.sha256_hash}_img-html-1.png")


def test_caps(spark):
    rows = spark.createDataFrame([("é" * 60_000,), ("x",), (None,)], "t string")
    assert [r.n for r in rows.select(F.octet_length(rf.cap_text(F.col("t"))).alias("n")).collect()] == [100_000, 1, None]


def test_dot_of_unlike_vectors(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert rows.select(tx.dot(F.col("a"), F.col("b"))).first()[0] == 11.0


def test_published_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert st.published(spark, path) == {}
    for version in (1, 2):
        st.publish({"a": spark.range(version), "b": spark.range(version)}, path, version)
    spark.range(9).write.parquet(f"{path}/v=3/a")  # a version that broke off
    found = st.published(spark, path)
    assert {name: rows.count() for name, rows in found.items()} == {"a": 2, "b": 2}


def test_agent_states(spark):
    def call(tool):
        return f'I call {{"tool": "{tool}", "args": {{}}}}'

    logs = {
        "asked": [call("CreateNode"), call("askhuman"), call("parsingComplete")],
        "done": ["?", "?", call("CreateTag"), "?", call("parseComplete")],
        "broken": [call("ParsingComplete")],
        "stuck": [call("nosuch"), '{"args": 1}', "prose", call("LinkNodes")],
        "running": [call("nosuch"), "prose", call("read_content_db")],
    }
    log = spark.createDataFrame([(s, i, i, t) for s, texts in logs.items() for i, t in enumerate(texts)], "session_id string, seq int, ts int, content string")
    failures = spark.createDataFrame([("broken", 0)], "session_id string, seq int")
    states = tl.session_status(tl.call_results(tl.extract_calls(log), log, failures))
    assert {r.session_id: (r.status, r.seq) for r in states.collect()} == {
        "asked": ("waiting", 1), "done": ("completed", 4), "broken": ("error", 0), "stuck": ("waiting", 2), "running": ("running", None),
    }
    bad = {(r.session_id, r.seq): r.error_message for r in tl.malformed(tl.extract_calls(log), log).collect()}
    assert bad[("stuck", 2)] == "no tool call" and ("stuck", 1) not in bad and ("stuck", 0) not in bad


def test_index_of_deltas(spark, tmp_path, monkeypatch):
    """Late older changes lose, deletions stay, and rewrites of the whole index change nothing."""
    schema = "document_id string, block_id string, op string, seq int, text string"
    batches = [
        [("d", "a", "insert", 1, "one two"), ("d", "b", "insert", 2, "three")],
        [("d", "a", "update", 9, "five"), ("d", "b", "delete", 8, None)],
        [("d", "a", "update", 4, "late"), ("d", "b", "update", 5, "late"), ("d", "c", "insert", 3, "")],
        [("d", "c", "update", 10, "six six")],
    ]
    for turn in (1, 2, 100):
        monkeypatch.setattr(postings, "TURN", turn)
        path = str(tmp_path / f"index-{turn}")
        assert jobs.latest_snapshot(spark, path) is None
        for n, rows in enumerate(batches):
            for _ in range(2):
                postings.apply_changes(spark, spark.createDataFrame(rows, schema), path, n)
        got = {(r.block_id, r.pos, r.term) for r in jobs.latest_snapshot(spark, path).collect()}
        assert got == {("a", 0, "five"), ("c", 0, "six"), ("c", 1, "six")}
        if turn == 100:  # an index that merges in every batch keeps no state before the last turn
            assert {r.block_id for r in jobs.latest_snapshot(spark, path, 1).collect()} == {"a", "b"}

"""Operators on literal fixtures, and loops rewritten as windows against their sequential form."""

import random

import pytest
from pyspark.sql import functions as F

from vellumspark.functions import text as tx
from vellumspark.operators import extract as ex
from vellumspark.operators import notes as no
from vellumspark.operators import reflow as rf
from vellumspark.operators import search as se
from vellumspark.operators import store as st
from vellumspark.operators import toolog as tl


def one(df):
    return df.first()[0]


def values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_block_id(spark):
    df = spark.range(1)
    assert one(df.select(tx.block_id(F.lit("doc_12345"), F.lit(1), F.lit("Chapter 1")))) == "blk_933ca4153e7ae2dd373403dcc5ce48f2832d842d00407044a524f22b510bcf64"
    assert one(df.select(tx.block_id(F.lit("doc_12345"), F.lit(1), F.lit("x")))) != one(df.select(tx.block_id(F.lit("doc_1234"), F.lit(51), F.lit("x"))))


@pytest.mark.parametrize(("text", "tokens", "expected"), [("Hello 🔥 世界中文 end", 1, "Hell"), ("中文", 1, "中"), ("", 1, ""), (None, 1, None)])
def test_truncate(spark, text, tokens, expected):
    assert one(values(spark, [(text,)], "t string").select(tx.truncate_tokens(F.col("t"), tokens))) == expected


@pytest.mark.parametrize(("tag", "expected"), [("  React Native  ", "reactnative"), ("SQLite FTS5 Trigger", "sqlitefts5trigger"), ("LLM-ingest", "llm-ingest"), ("   ", "")])
def test_tags(spark, tag, expected):
    assert one(spark.range(1).select(tx.normalise_tag(F.lit(tag)))) == expected


def test_strip_elements(spark):
    html = "<header>keep</header><head><title>x</title></head><script src='a'>bad()</script><p>Hello</p>"
    assert one(spark.range(1).select(tx.strip_elements(F.lit(html)))) == "<header>keep</header><p>Hello</p>"


@pytest.mark.parametrize(
    ("broken", "expected"),
    [('{"arr": [{"nested": "val', '{"arr": [{"nested": "val"}]}'), ('{key: "value", }', '{"key": "value"}'), ('{"a": "x{y', '{"a": "x{y"}'), ('{"a": 1}', '{"a": 1}')],
)
def test_repair(spark, broken, expected):
    assert one(spark.range(1).select(tl.repair_json(F.lit(broken), aggressive=True))) == expected


def test_markdown_headings(spark):
    docs = values(spark, [("d", "## 标题\nSome text\n###NoSpaceHeading\n"), ("e", "")], "document_id string, text string")
    titles = {(r.document_id, r.title) for r in ex.markdown_sections(docs).collect()}
    assert titles == {("d", "Default Section"), ("d", "标题"), ("e", "Default Section")}
    assert {r.block_type for r in ex.markdown_blocks(docs).collect()} == {"heading", "paragraph"}


def test_section_parents_match_a_stack(spark):
    rng = random.Random(1)
    docs = [(str(i), "\n".join("#" * rng.randint(1, 6) + " t" for _ in range(rng.randint(0, 9)))) for i in range(60)]
    found = {(r.document_id, r.sort_order): r.parent_id for r in ex.markdown_sections(values(spark, docs, "document_id string, text string")).collect()}
    for doc, text in docs:
        stack = [(1, f"sec-{doc}-default")]
        for n, line in enumerate((x for x in text.split("\n") if x), 1):
            depth = len(line.split(" ")[0])
            while stack and stack[-1][0] >= depth:
                stack.pop()
            assert found[doc, n] == (stack[-1][1] if stack else None)
            stack.append((depth, f"sec-md-{doc}-{n}"))


def test_delineate_matches_a_loop(spark):
    rng = random.Random(2)
    kinds = ["", "[Image: local-asset://a.png]", "Chapter 1", "1. Intro", "Short Title", "a plain line of text", "Ends with dot.", "[Image: none]"]
    docs = [(str(i), "\n".join(rng.choice(kinds) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    got: dict = {}
    for r in ex.delineate(values(spark, docs, "document_id string, text string")).orderBy("document_id", "sort_order").collect():
        got.setdefault(r.document_id, []).append((r.block_type, r.text or r.src))
    for doc, text in docs:
        blocks, para = [], []

        def flush(blocks=blocks, para=para):
            if para:
                blocks.append(("paragraph", " ".join(para)))
                para.clear()

        for line in text.split("\n"):
            if not line:
                flush()
            elif line.startswith("[Image:"):
                flush()
                blocks.append(("image", "local-asset://a.png" if "asset" in line else "local-asset://default.png"))
            elif line in ("Chapter 1", "1. Intro") or (line == "Short Title" and not para):
                flush()
                blocks.append(("heading", line))
            else:
                para.append(line)
        flush()
        assert got[doc] == (blocks or [("paragraph", "Empty page content.")])


def test_html_blocks(spark):
    html = "<head><title>t</title></head>lead<h1 class='a'>Top</h1><p>one</p>loose<blockquote>q</blockquote><table><tr><td>c</td></tr></table><img src='x' alt='y'>tail"
    rows = ex.html_blocks(values(spark, [("d", html), ("e", None)], "document_id string, html string")).orderBy("sort_order").collect()
    assert [(r.block_type, r.text, r.section) for r in rows] == [
        ("paragraph", "lead", 0), ("heading", "Top", 1), ("paragraph", "one", 1), ("paragraph", "loose", 1), ("quote", "q", 1), ("table", "<tr><td>c</td></tr>", 1), ("image", None, 1),
    ]


def test_chunks(spark):
    long = " ".join(["w"] * 200)
    docs = values(spark, [("a", "one\n\ntwo"), ("b", f"{long}. {long}"), ("c", long), ("d", ""), ("e", None)], "document_id string, text string")
    counts = {r.document_id: r["count"] for r in ex.chunk(docs).groupBy("document_id").count().collect()}
    assert counts["a"] == 1 and counts["b"] == 2 and counts["c"] == 1 and counts["d"] == 1


def test_search_forms(spark):
    blocks = values(spark, [("d", "b1", "The quick Élan"), ("d", "b2", "quick the"), ("d", "b3", "")], "document_id string, block_id string, text string")
    tokens = se.tokenise(blocks)
    ids = lambda df: sorted(r.block_id for r in df.collect())
    assert ids(se.match(tokens, "THE quick")) == ["b1", "b2"]
    assert ids(se.match(tokens, "elan")) == ["b1"]
    assert ids(se.match(tokens, "!?")) == []
    assert ids(se.match_phrase(tokens, "the quick")) == ["b1"]
    assert ids(se.match_prefix(tokens, "qui")) == ["b1", "b2"]
    assert ids(se.match_not(tokens, "quick", "elan")) == ["b2"]


def test_vectors(spark):
    df = values(spark, [([1.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in df.select(tx.cosine(F.col("a"), F.col("b"))).collect()] == [0.7071, 0.0, 0.0, 0.0]
    empty = se.hash_embedding(values(spark, [(1, ""), (2, "word")], "id int, text string"))
    assert {(r.id, r.dim, r.value) for r in empty.where("id = 1").collect()} == {(1, 0, 1.0)}
    norms = se.dense(empty).select(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).collect()
    assert all(abs(r[0] - 1) < 1e-9 for r in norms)


def test_merge(spark):
    notes = [
        ("disjoint", "a\nb\nc\n", "A\nb\nc\n", "a\nb\nC\n"),
        ("clash", "a\nb\nc\n", "a\nX\nc\n", "a\nY\nc\n"),
        ("same", "a\nb\n", "a\nZ\n", "a\nZ\n"),
        ("ours", "a", "b", "a"),
        ("empty", "", "x", "y"),
        ("insert", "a\nb\nc\nd\n", "a\nnew\nb\nc\nd\n", "a\nb\nc\n"),
        ("null", None, None, "t"),
    ]
    found = {r.id: (r.merged, r.has_conflict) for r in no.merge_notes(values(spark, notes, "id string, base string, ours string, theirs string")).collect()}
    assert found["disjoint"] == ("A\nb\nC\n", False)
    assert found["clash"] == ("a\n<<<<<<< OURS\nX\n=======\nY\n>>>>>>> THEIRS\nc\n", True)
    assert found["same"] == ("a\nZ\n", False) and found["ours"] == ("b", False)
    assert found["empty"] == ("<<<<<<< OURS\nx\n=======\ny\n>>>>>>> THEIRS", True)
    assert found["insert"] == ("a\nnew\nb\nc\n", False) and found["null"] == ("t", False)


def test_reanchor(spark):
    schema = "document_id string, annotation_id string, highlighted_text string, prefix string, suffix string, offset int"
    notes = [
        ("d", "both", "target", "the quick ", " jumps", 0), ("e", "suffix", "target", "zzz", " jumps", 0), ("f", "bare", "target", "", "", 0), ("g", "gone", "absent", "", "", 0), ("h", "cjk", "目标", "一二三四五六七", "", 0),
    ]
    blocks = [("d", "b", 0, "so the quick target jumps"), ("e", "b", 0, "abc target jumps"), ("f", "b", 0, "target"), ("g", "b", 0, "text"), ("h", "b", 0, "一二三四五六七目标")]
    got = no.reanchor(values(spark, notes, schema), values(spark, blocks, "document_id string, block_id string, sort_order int, text string"))
    found = {r.annotation_id: (r.start, round(r.confidence, 4)) for r in got.collect()}
    assert found["both"] == (13, 1.0) and found["suffix"] == (4, 0.75) and found["bare"] == (0, 0.5) and found["cjk"][0] == 21 and "gone" not in found


def test_packets(spark):
    payloads = values(spark, [("t", "A" * 1000), ("u", "é" * 300), ("v", "")], "tx string, payload string")
    packets = no.packetise(payloads)
    assert sorted((r.i, r.n, len(r.data.encode())) for r in packets.where("tx = 't'").collect()) == [(0, 2, 512), (1, 2, 488)]
    assert all(len(r.data.encode()) <= 512 for r in packets.collect())
    again = {r.tx: r.payload for r in no.reassemble(packets).collect()}
    assert again == {"t": "A" * 1000, "u": "é" * 300}  # an empty payload has no packet
    broken = no.reassemble(packets.where("NOT (tx = 't' AND i = 1)").withColumn("data", F.when(F.col("tx") == "u", F.lit("bad")).otherwise(F.col("data"))))
    assert {r.tx: (r.progress, r.payload) for r in broken.collect()} == {"t": (50.0, None)}


def test_highlights_match_a_loop(spark):
    rng = random.Random(3)
    texts = [(f"b{i}", "".join(rng.choice("ab ") for _ in range(rng.randint(0, 25)))) for i in range(40)]
    notes = [(b, f"{b}-{n}", "".join(rng.choice("ab") for _ in range(rng.randint(1, 3))), "red") for b, _ in texts for n in range(2)]
    got: dict = {}
    for r in rf.highlight_segments(values(spark, texts, "block_id string, text string"), values(spark, notes, "block_id string, annotation_id string, highlighted_text string, color string")).orderBy("block_id", "n").collect():
        got.setdefault(r.block_id, []).append((r.text, r.is_highlighted))
    for b, text in texts:
        hits = sorted((i, i + len(h)) for o, _, h, _ in notes if o == b for i in range(len(text)) if text.startswith(h, i))
        merged: list = []
        for s, e in hits:
            if merged and s < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        parts, at = [], 0
        for s, e in merged:
            if s > at:
                parts.append((text[at:s], False))
            parts.append((text[s:e], True))
            at = e
        if at < len(text) or not merged:
            parts.append((text[at:], False))
        assert got[b] == parts


def test_reading_order(spark):
    schema = "document_id string, page int, token_no int, left double, bottom double, right double, top double, text string"
    rows = [("a", 1, 0, 100.0, 10.0, 140.0, 20.0, "World"), ("a", 1, 1, 10.0, 10.0, 50.0, 20.0, "Hello")]
    rows += [("b", 1, 0, 310.0, 10.0, 350.0, 20.0, "Col2"), ("b", 1, 1, 10.0, 10.0, 50.0, 20.0, "Col1"), ("b", 1, 2, 10.0, 5.0, 50.0, 15.0, "Bottom")]
    rows += [("c", 1, i, x, y, x + 40, y + 10, t) for i, (x, y, t) in enumerate([(310.0, 100.0, "R1"), (10.0, 90.0, "L1"), (10.0, 70.0, "L2"), (310.0, 50.0, "R2")])]
    got = {d: [r.text for r in rf.reading_order(values(spark, rows, schema)).where(F.col("document_id") == d).orderBy("rank").collect()] for d in ("a", "b", "c")}
    assert got["a"] == ["Hello", "World"]
    assert got["b"] == ["Col1", "Bottom", "Col2"]
    assert got["c"] == ["L1", "L2", "R1", "R2"]


def test_pages_cover_texts(spark):
    schema = "document_id string, section_id string, sort_order int, block_id string, block_type string, text string, height double"
    text = "word " * 400
    rows = [("d", "s", 0, "b0", "paragraph", text, 3000.0), ("d", "s", 1, "b1", "image", "", 300.0), ("d", "s", 2, "b2", "paragraph", None, 40.0)]
    pages = rf.paginate(values(spark, rows, schema), 844.0).orderBy("page", "start").collect()
    own = [(r.start, r.end) for r in pages if r.block_id == "b0"]
    assert own[0][0] == 0 and own[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    assert {r.block_id for r in pages} == {"b0", "b1"}


def test_three_failures_wait(spark):
    rows = [("s", i, i, f, False) for i, f in enumerate([True, False, True, True, True])] + [("t", 0, 0, True, False)]
    got = tl.session_status(values(spark, rows, "session_id string, ts int, seq int, failed boolean, done boolean")).collect()
    assert {(r.session_id, r.status, r.seq) for r in got} == {("s", "waiting", 4), ("t", "running", None)}


def test_occurrences_against_a_loop(spark):
    rng = random.Random(8)
    pairs = [("".join(rng.choice("ab\\E.é ") for _ in range(rng.randint(0, 40))), "".join(rng.choice("ab\\E. ") for _ in range(rng.randint(0, 3)))) for _ in range(600)]
    df = values(spark, [(i, t, n) for i, (t, n) in enumerate(pairs)], "id long, text string, needle string")
    for r in df.select("id", no.occurrences(F.col("text"), F.col("needle")).alias("at")).collect():
        text, needle = pairs[r.id]
        assert list(r["at"]) == [i for i in range(len(text)) if needle and text.startswith(needle, i)], (text, needle)


def test_anchor_candidates_lose_none(spark):
    """Notes of many words are looked up by a word; the pairs hold every block that contains the note."""
    rng = random.Random(3)
    blocks = [("d", f"b{i}", i, " ".join(rng.choice(["aa", "bb", "cc", "a\tb", "bbb"]) for _ in range(6))) for i in range(60)]
    notes = []
    for i, (_, _, _, text) in enumerate(blocks):
        at = rng.randint(0, 6)
        notes.append(("d", f"n{i}", text[at : at + rng.randint(2, 9)].strip()))
    notes = [n for n in notes if n[2]]
    pairs = no._with_candidates(values(spark, notes, "document_id string, annotation_id string, needle string"), values(spark, blocks, "document_id string, block_id string, sort_order int, text string"))
    got = {(r.annotation_id, r.block_id) for r in pairs.where(F.contains("text", "needle")).collect()}
    assert got == {(n, b) for _, n, needle in notes for _, b, _, text in blocks if needle in text}


def test_packets_are_greedy_and_whole(spark):
    rng = random.Random(2)
    texts = ["", None, "A" * 1000, "é" * 700, "🔥" * 300] + ["".join(rng.choice("aé漢🔥") for _ in range(rng.randint(1, 2500))) for _ in range(20)]
    packets = no.packetise(values(spark, list(enumerate(texts)), "tx long, payload string"))
    found = {}
    for r in packets.orderBy("tx", "i").collect():
        found.setdefault(r.tx, []).append(r.data)
        h = 5381
        for c in r.data:
            h = (h * 33) % 2**32 ^ ord(c)
        assert r.checksum == f"{h:x}"
    for i, text in enumerate(texts):
        expected, now = [], ""
        for c in text or "":
            if len((now + c).encode()) > 512:
                expected, now = [*expected, now], ""
            now += c
        assert found.get(i, []) == expected + [now] * bool(now)
    whole = {r.tx: r.payload for r in no.reassemble(packets).collect()}
    assert whole == {i: t for i, t in enumerate(texts) if t}


def test_cascade_reaches_every_depth(spark):
    tables = {
        "documents": values(spark, [("d", "c"), ("e", "x")], "id string, corpus_id string"),
        "sections": values(spark, [("s", "d", None), ("s1", "e", "s"), ("s2", "e", "s1"), ("t", "e", None)], "id string, document_id string, parent_id string"),
        "blocks": values(spark, [("b", "s2", "e"), ("b2", "t", "e")], "id string, section_id string, document_id string"),
        "tags": values(spark, [("g", "n"), ("h", "n")], "id string, name string"),
        "block_tags": values(spark, [("b", "g"), ("b2", "g")], "block_id string, tag_id string"),
        "vector_cache": values(spark, [("b", 1), ("b2", 1)], "block_id string, vector int"),
    }
    out = st.cascade_delete(tables, "sections", values(spark, [("s",)], "id string"))
    assert {n: sorted(r[0] for r in t.collect()) for n, t in out.items()} == {"documents": ["d", "e"], "sections": ["t"], "blocks": ["b2"], "tags": ["g", "h"], "block_tags": ["b2"], "vector_cache": ["b2"]}
    assert sorted(r[0] for r in st.cascade_delete(tables, "documents", values(spark, [("e",)], "id string"))["blocks"].collect()) == []
    report = {(r.table, r.rule, r.key): r["count"] for r in st.integrity_report({**tables, "blocks": out["blocks"]}, {"tags": ["id"]}).collect()}
    assert report == {("tags", "unique", "n"): 2, ("block_tags", "reference", "b"): 1, ("vector_cache", "reference", "b"): 1}


def test_calls_are_repaired_to_the_end(spark):
    log = values(spark, [("s", 1, 'call {"tool": "Save", "args": {"id": "1"}, "content": "cut of'), ("s", 2, 'x {"tool": "a"} y'), ("s", 3, "none")], "session_id string, seq int, content string")
    got = {r.seq: (r.tool, r.args, r.status) for r in tl.extract_calls(log).collect()}
    assert got == {1: ("Save", '{"id":"1"}', "repaired"), 2: ("a", None, "ok"), 3: (None, None, "malformed")}


def test_short_needles_meet_only_blocks_with_their_gram(spark):
    rng = random.Random(8)
    words = ["ab", "Cd", "efg", "hij.", "漢字", "é", "the", "there"]
    blocks = [(str(d), f"{d}-{i}", i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for d in range(8) for i in range(6)]
    needles = ["a", "漢", "Cd", "the", "b C", "ere the", "absent", "ij. 漢", "é é", "fg"]
    notes = [(str(d), f"n{d}-{k}", n) for d in range(8) for k, n in enumerate(needles)]
    b = spark.createDataFrame(blocks, "document_id string, block_id string, sort_order int, text string")
    a = spark.createDataFrame(notes, "document_id string, annotation_id string, needle string")
    found = [(r.annotation_id, r.block_id, r.needle, r.text) for r in no._with_candidates(a, b).collect()]
    holds = {(n, k) for d, n, needle in notes for e, k, _, text in blocks if d == e and needle in text}
    assert len(found) == len(set(found)) and holds <= {x[:2] for x in found}
    assert all(any(needle[i : i + min(3, len(needle))] in text for i in range(max(len(needle) - 2, 1))) for _, _, needle, text in found)
    assert len(found) < 1.6 * len(holds)


def test_every_block_with_a_needle_is_a_candidate_whatever_the_number_of_keys(spark):
    """One document of few keys, which are searched for in the text, and one of more than are searched for one by one."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé\n") for _ in range(rng.randint(1, 6)))
    blocks = [(doc, f"{doc}-{i}", i, " ".join(word() for _ in range(40))) for doc in ("few", "many") for i in range(12)]
    notes = []
    for doc, n in (("few", 5), ("many", 400)):
        for i in range(n):
            text = rng.choice([b[3] for b in blocks if b[0] == doc])
            at = rng.randrange(len(text))
            needle = text[at : at + rng.choice([1, 2, 3, 9, 25])].strip() or "zz"
            notes.append((doc, f"{doc}{i}", needle))
    a = spark.createDataFrame(notes, "document_id string, annotation_id string, needle string")
    b = spark.createDataFrame(blocks, "document_id string, block_id string, sort_order int, text string")
    assert no._shared(a.selectExpr("document_id", "needle AS key").distinct(), b).count() > 0
    found = [(r.annotation_id, r.block_id) for r in no._with_candidates(a, b).collect() if r.needle in r.text]
    want = [(n[1], block[1]) for n in notes for block in blocks if n[0] == block[0] and n[2] in block[3]]
    assert sorted(found) == sorted(want)

"""Plans and results that keep work in proportion to the input."""

from pyspark.sql import functions as F

from vellumspark.operators import notes as no


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_packets_are_cut_once_and_checked_once(spark):
    sent = no.packetise(spark.createDataFrame([("t", "aé😀|" * 500), ("u", "x"), ("v", ""), ("w", None)], "tx string, payload string"))
    # one fold for the cuts and one for the checksum; a filter on the parts would repeat the first for every part
    assert _plan(sent).count("aggregate(") == 2
    lines = no.to_wire(sent).withColumn("arrival", F.lit(1))
    packets, rejects = no.from_wire(lines)
    assert "aggregate(" not in _plan(packets) and "aggregate(" not in _plan(rejects)
    assert rejects.count() == 0
    assert {r.tx: r.payload for r in no.reassemble(packets, checked=True).collect()} == {"t": "aé😀|" * 500, "u": "x"}


def test_layout_of_pages_shuffles_no_glyphs(spark, sf):
    from vellumspark.plans import records

    for name in ("p7_all_pages", "p8_reading_order"):
        plan = records.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_glyph_rows_and_pages_give_the_same_tokens(spark):
    from vellumspark.operators import reflow as rf

    text = [" ab  c\t", "\n ", "d", "xy z"]
    rows = [("d", p, i, ch, float(i), 1.0, i + 0.5, 2.0 + i, float(10 + i)) for p, t in enumerate(text) for i, ch in enumerate(t)]
    rows.append(("d", 3, 9, None, 9.0, 9.0, 9.0, 9.0, 9.0))
    glyphs = spark.createDataFrame(rows, "document_id string, page int, idx int, glyph string, left double, bottom double, right double, top double, font_size double")
    found = [tuple(r) for r in rf.glyphs_to_tokens(glyphs).orderBy("page", "token_no").collect()]
    assert found == [
        ("d", 0, 0, 1.0, 1.0, 2.5, 4.0, 12.0, "ab"), ("d", 0, 1, 5.0, 1.0, 5.5, 7.0, 15.0, "c"), ("d", 2, 0, 0.0, 1.0, 0.5, 2.0, 10.0, "d"),
        ("d", 3, 0, 0.0, 1.0, 1.5, 3.0, 11.0, "xy"), ("d", 3, 1, 3.0, 1.0, 3.5, 5.0, 13.0, "z"),
    ]
    gathered = glyphs.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("idx", "glyph", "left", "bottom", "right", "top", "font_size"))).alias("glyphs"))
    assert rf.token_rows(rf.page_tokens(gathered.where("page <> 3"), 1)).count() == 2


def test_embeddings_shuffle_texts_once(spark):
    from vellumspark.operators import search as se

    texts = spark.createDataFrame([("a", "one two one"), ("b", ""), ("c", " ?! "), ("d", None), ("e", "three")], "id string, text string")
    found = se.hash_embedding(texts)
    assert _plan(found).count("RepartitionByExpression") == 1 and "Join" not in _plan(found)
    rows = found.collect()
    assert {r.id: (r.dim, r.value) for r in rows if r.id in "bcd"} == {x: (0, 1.0) for x in "bcd"}
    for x in "ae":
        assert abs(sum(r.value**2 for r in rows if r.id == x) - 1) < 1e-9


def test_asset_files_are_written_by_many_tasks(spark, sf):
    from vellumspark.plans import lookups

    names = lookups.QUERIES["s6_scan_assets"](spark, sf).inputFiles()
    assert len({name.rsplit("/", 1)[1][:10] for name in names}) > 1


def test_search_text_counts_no_distinct_words(spark):
    from vellumspark.operators import search as se

    many = " ".join(f"w{i}" for i in range(70))
    texts = {"a": "the of the the", "b": "of x the with", "c": "there from", "d": f"z {many}", "e": many.replace("w33", "v")}
    tokens = se.tokenise(spark.createDataFrame([("d", k, v) for k, v in texts.items()], "document_id string, block_id string, text string"))
    found = se.search(tokens, '"of the" OR "the the" OR ther* NOT with')
    assert "distinct" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.block_id for r in found.collect()) == ["a", "c"]
    assert [r.block_id for r in se.search(tokens, f'"{many}"').collect()] == ["d"]


def test_lines_and_spans_are_dealt_by_their_number(spark, monkeypatch):
    from vellumspark.operators import extract as ex

    monkeypatch.setattr(ex, "PART_CHARS", 100)
    docs = spark.createDataFrame([(str(i), "![a](x.png)\n" * 5) for i in range(40)], "document_id string, text string")
    found = ex.image_refs(docs)
    assert found.rdd.getNumPartitions() == 24 and found.count() == 200 and found.where("image_id = 'img-md-5'").count() == 40
    monkeypatch.setattr(no, "PART_SPANS", 10)
    spans = no.merge_highlights(spark.range(100).selectExpr("id DIV 2 AS block_id", "id % 2 * 3 AS start", "5L + id % 2 AS end"))
    assert spans.rdd.getNumPartitions() == 10 and spans.count() == 50 and spans.where("spans = 2 AND end = 6").count() == 50


def test_blocks_of_markdown_need_no_join(spark):
    from vellumspark.operators import extract as ex

    text = "# T\n```\na\n\nb\n```\n- x\n```\n```\n![p](q)\n```\nopen"
    found = ex.markdown_blocks(spark.createDataFrame([("d", text), ("e", None), ("f", "")], "document_id string, text string"))
    assert "Join" not in _plan(found) and found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = sorted((r.sort_order, r.block_type, r.content) for r in found.collect())
    assert [r[1] for r in rows] == ["heading", "code", "paragraph", "code", "image"]
    assert '"code":"a\\n\\nb"' in rows[1][2] and '"code":""' in rows[3][2]


def test_pairs_are_cells_not_joined_rows(spark):
    from vellumspark.functions import text as tx
    from vellumspark.operators import search as se

    rows = [(i, "k" if i % 3 else "l", [float((i * 7 + j) % 11) / 3 - 1 for j in range(5 if i % 11 else 4)]) for i in range(90)]
    rows += [(500, "k", None), (501, "k", [None, 1.0]), (502, "k", [0.0] * 5), (503, "k", []), (504, None, [1.0])]
    vectors = spark.createDataFrame(rows, "id long, label string, vector array<double>")
    found = se.similarities(vectors.where("id % 4 = 0"), vectors, "label", block=16)
    assert "FlatMapCoGroupsInArrow" in _plan(found)
    pairs = vectors.where("id % 4 = 0").select("label", F.col("id").alias("target_id"), F.col("vector").alias("tv")).join(vectors, "label")
    expected = pairs.select("target_id", "id", tx.cosine(F.col("tv"), F.col("vector")).alias("score"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_few_notes_are_searched_for_without_grams_of_the_blocks(spark, monkeypatch):
    """Few notes make no keys at all; a document above the bound is looked up by keys and finds the same."""
    from vellumspark.operators import notes as no

    blocks = [(doc, f"{doc}-{i}", i, f"line {i} of {doc} ünd ünd line {i % 7}") for doc in ("few", "many") for i in range(300)]
    notes = [(doc, f"{doc}{i}", needle) for doc, n in (("few", 6), ("many", 9)) for i, needle in enumerate(["line 29", "ünd ünd", "absent", "of few", "7", "line 3 of", "ne 5", "l", "d l"][:n])]
    b = spark.createDataFrame(blocks, "document_id string, block_id string, sort_order int, text string")
    a = spark.createDataFrame(notes, "document_id string, annotation_id string, needle string")
    want = sorted((n[1], k[1]) for n in notes for k in blocks if n[0] == k[0] and n[2] in k[3])
    found = lambda: sorted((r.annotation_id, r.block_id) for r in no._with_candidates(a, b).collect() if r.needle in r.text)
    monkeypatch.setattr(no, "FEW_NOTES", 7)
    assert found() == want
    monkeypatch.setattr(no, "FEW_NOTES", 512)
    monkeypatch.setattr(no, "_keys", None)
    assert found() == want


def test_a_tree_is_parsed_once_and_levels_that_hold_nothing_are_not_walked(spark, monkeypatch):
    from vellumspark.operators import tree

    written, keep = [], tree.materialise
    monkeypatch.setattr(tree, "materialise", lambda df, name: written.append(name) or keep(df, name))
    blocks = spark.createDataFrame([("b", '{"a":[1,{"text":"x"}]}'), ("c", "plain")], "block_id string, content string")
    rows, rejects = tree.tree_rows(blocks)
    assert written == ["tree-roots"] + ["tree-level"] * 3
    assert "parse_json" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.path, r.value) for r in rows.collect()) == [("$.a", None), ("$.a[0]", "1"), ("$.a[1]", None), ("$.a[1].text", "x")]
    assert rejects.count() == 0


def _pages_of_boxes(seed, pages=300):
    """Pages of boxes that overlap, repeat, lie on one side or touch, some without any."""
    import random

    rng = random.Random(seed)
    made = []
    for _ in range(pages):
        step, spread = rng.choice([(1, 60), (4, 90), (12, 200)]), rng.choice([(0, 590), (0, 250), (310, 590)])
        boxes = []
        for _ in range(rng.choice([0, 1, 2, 9, 30, 70])):
            low, x = step[0] * rng.randrange(step[1] // step[0]), rng.randrange(*spread) * rng.choice([1.0, 1.0, 0.5])
            boxes.append((x, float(low), x + rng.choice([5.0, 40.0]), low + rng.choice([10.0, 10.0, 22.0, 7.5])))
        made.append(boxes)
    return made


def test_pages_are_read_many_at_once(monkeypatch):
    """The tokens of many pages are read together, none page by page, and in the order of the fold over one page."""
    import pyarrow as pa

    from vellumspark.operators import reflow as rf

    for tolerance in (8.0, 3.0, 0.0):
        pages = _pages_of_boxes(int(tolerance))
        expected = [[(i, c, n, k, str(i)) for k, (i, c, n) in enumerate(rf._order(boxes, 300.0, tolerance))] for boxes in pages]
        tokens = [[dict(zip(("left", "bottom", "right", "top"), box, strict=True)) | {"text": str(i)} for i, box in enumerate(boxes)] for boxes in pages]
        batch = pa.RecordBatch.from_pydict({"document_id": ["d"] * len(pages), "page": list(range(len(pages))), "tokens": tokens})
        with monkeypatch.context() as patch:
            patch.setattr(rf, "_order", None)
            at, words = rf._read(batch.slice(3), 300.0, tolerance)
        rows = list(zip(*[w.to_pylist() for w in words], strict=True))
        assert [rows[a:b] for a, b in zip(at, at[1:], strict=False)] == expected[3:]
    one = pa.RecordBatch.from_pydict({"document_id": ["d", "d"], "page": [1, 2], "tokens": [None, [{"left": 1.0, "bottom": float("nan"), "right": 2.0, "top": 3.0, "text": "x"}]]})
    assert [w.to_pylist() for w in rf._read(one, 300.0, 8.0)[1]] == [[0], [0], [0], [0], ["x"]]


def test_texts_of_pages_take_no_rows_of_words(spark, sf):
    """Texts leave the task that reads the characters; no glyph, token or word passes through the JVM."""
    from vellumspark.operators import reflow as rf
    from vellumspark.plans import records

    plan = records.QUERIES["p9_page_text"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "array_join(words" not in plan and "named_struct" not in plan and plan.count("MapInArrow") == 1
    boxes = "array<struct<left:double,bottom:double,right:double,top:double,text:string>>"
    pages = spark.createDataFrame([("a", 1, [(50.0, 0.0, 60.0, 9.0, "b"), (1.0, 0.0, 9.0, 9.0, "a"), (70.0, 1.0, 75.0, 9.0, None)]), ("a", 2, []), ("b", 1, None)], f"document_id string, page int, tokens {boxes}")
    images = spark.createDataFrame([("a", 1, "u"), ("c", 3, "v")], "document_id string, page int, uri string")
    assert {tuple(r) for r in rf.read_text(pages, images).collect()} == {("a", 1, "a b [Image: u]"), ("c", 3, "[Image: v]")}


def test_words_and_tokens_of_pages_are_rows_of_one_task(spark, sf):
    """Rows of words and tokens come out of the task that reads the characters: no expression for every glyph and no arrays taken apart."""
    from vellumspark.plans import records

    for name in ("p8_reading_order", "p7_all_pages"):
        plan = records.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and plan.count("Generate") == 1 and "lambda" not in plan


def test_tokens_of_pages_match_a_loop():
    """Tokens of many pages at once: white space of several characters, no glyph, empty pages, and the cap of a page."""
    import random

    import pyarrow as pa

    from vellumspark.operators import reflow as rf

    rng = random.Random(4)
    kinds = ["a", "é", "😀", "ab", " x", " ", "\n", "\x0b", " \t", "", None, " "]
    pages = [[{"glyph": rng.choice(kinds), "left": rng.random(), "bottom": rng.random(), "right": rng.random(), "top": rng.random(), "font_size": float(k)} for k in range(rng.choice([0, 1, 5, 40]))] for _ in range(200)]
    batch = pa.RecordBatch.from_pydict({"document_id": ["d"] * 200, "page": list(range(200)), "glyphs": pages})
    for cap in (1000, 3):
        found = rf.tokens_of(batch.slice(1), cap).column("tokens").to_pylist()
        for page, tokens in zip(pages[1:], found, strict=True):
            runs, last = [], True
            for g in page:
                blank = not (g["glyph"] or "").strip(" \t\n\x0b\f\r")
                if not blank:
                    runs = [*runs, []] if last else runs
                    runs[-1].append(g)
                last = blank
            edges = [("left", min), ("bottom", min), ("right", max), ("top", max)]
            assert tokens == [{side: pick(g[side] for g in run) for side, pick in edges} | {"font_size": run[-1]["font_size"], "text": "".join(g["glyph"] for g in run)} for run in runs[:cap]]

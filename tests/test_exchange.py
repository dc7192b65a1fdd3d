"""Tree rows, wire packets, backups, reads of a log, hooks, grids of vectors and contexts on small inputs."""

import json
import random

from pyspark.sql import functions as F

from vellumspark.functions import text as tx
from vellumspark.operators import notes as no
from vellumspark.operators import search as se
from vellumspark.operators import toolog as tl
from vellumspark.operators import tree
from vellumspark.sources import backup


def _walk(value, path="$"):
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in items:
        at = f"{path}.{k}" if isinstance(value, dict) else f"{path}[{k}]"
        yield at, str(k), None if isinstance(v, (dict, list)) or v is None else str(v).lower() if isinstance(v, bool) else str(v)
        yield from _walk(v, at)


def test_tree_rows_to_a_depth(spark):
    docs = {"a": {"x": [1, {"y": "z"}, []], "t": None, "u": {"v": True}}, "b": [[["deep", {"k": "w"}]]], "c": "text", "d": {}}
    blocks = spark.createDataFrame([*((k, json.dumps(v)) for k, v in docs.items()), ("e", "no json {"), ("f", None)], "block_id string, content string")
    rows, rejects = tree.tree_rows(blocks)
    assert {tuple(r)[:4] for r in rows.collect()} == {(k, *r) for k, v in docs.items() for r in _walk(v)} and rejects.count() == 0
    rows, rejects = tree.tree_rows(blocks, depth=2)
    assert {r.path for r in rows.where("block_id = 'b'").collect()} == {"$[0]", "$[0][0]"}
    assert {tuple(r) for r in rejects.collect()} == {("a", "$.x[1]"), ("b", "$[0][0]")}


def test_lines_of_packets(spark):
    payload = "a|b|" * 300 + "é"
    sent = no.to_wire(no.packetise(spark.createDataFrame([("t", payload)], "tx string, payload string"))).collect()
    lines = [(n, r.line) for n, r in enumerate(sent)]
    c = spark.range(1).select(tx.checksum(F.lit("zz"))).first()[0]
    bad = [(90, "t|0"), (91, None), (92, "|0|1|x|y"), (93, "t|9|3|x|y"), (94, "t|-1|3|x|y"), (95, "t|a|3|x|y"), (96, "t|0|3|0|y"), (97, "")]
    packets, rejects = no.from_wire(spark.createDataFrame([*lines, *bad, (-5, f"t|0|3|{c}|zz")], "arrival long, line string"))
    assert {r.arrival: r.reason for r in rejects.collect()} == {90: "fields", 91: "fields", 92: "fields", 93: "number", 94: "number", 95: "number", 96: "checksum", 97: "fields"}
    assert [tuple(r) for r in no.reassemble(packets).collect()] == [("t", 100.0, payload)]
    late = packets.withColumn("arrival", F.when(F.col("data") == "zz", 99).otherwise(F.col("arrival")))
    assert no.reassemble(late).first().payload.startswith("zz")
    unordered = packets.withColumn("arrival", F.lit(None).cast("long"))  # equal orders: the greatest text
    assert no.reassemble(unordered).first().payload.startswith("zz") and no.reassemble(packets.drop("arrival")).first().payload.startswith("zz")


def test_backup_files(spark, tmp_path):
    documents = spark.createDataFrame([("1", "T", "h1"), ("2", None, "h2"), ("3", "U", None)], "document_id string, title string, sha256_hash string").withColumn("id", F.lit("clash"))
    notes = spark.createDataFrame([("1", "b", 'quo"te\n', "x"), ("1", "a", None, None), ("9", "z", "lost", None)], "document_id string, id string, note_body string, tags string")
    tags = spark.createDataFrame([("a", "two"), ("a", "one"), ("a", "one"), ("q", "none")], "annotation_id string, name string")
    backup.write(backup.payloads(documents, notes, tags), str(tmp_path / "b"))
    found, annotations, rejects = backup.read(spark, str(tmp_path / "b"))
    assert {(r.document_id, r.schema_version, r.title) for r in found.collect()} == {("1", 2, "T"), ("2", 2, None)}
    assert {(r.document_id, r.id, r.note_body, tuple(r.tags)) for r in annotations.collect()} == {("1", "a", None, ("one", "two")), ("1", "b", 'quo"te\n', ())}
    assert [r.reason for r in rejects.collect()] == ["no document"]
    old = json.dumps({"document_id": "7", "payload": json.dumps({"document": {"sha256_hash": "h", "more": 1}, "annotations": [{"id": "n"}, {"note_body": "no id"}]})})
    spark.createDataFrame([(old,), ("{",), ("",), (old.replace('{\\"document\\"', '{\\"schema_version\\": 3, \\"document\\"'),)], "value string").write.text(str(tmp_path / "c"))
    found, annotations, rejects = backup.read(spark, str(tmp_path / "c"))
    assert [(r.document_id, r.schema_version) for r in found.collect()] == [("7", 1)] and [(r.id, r.tags) for r in annotations.collect()] == [("n", [])]
    assert sorted(r.reason for r in rejects.collect()) == ["damaged", "damaged", "newer"]


def test_reads_see_what_was_there_before(spark):
    created = spark.createDataFrame([("d", 1, "a"), ("d", 5, "b"), ("d", 9, "c"), ("e", 2, "x")], "document_id string, seq long, id string")
    reads = spark.createDataFrame([("d", 0), ("d", 5), ("d", 6), ("d", 99), ("f", 7)], "document_id string, seq long")
    assert {r.seq: (r.rows, r.last_id) for r in tl.as_of(reads, created).collect()} == {0: (0, None), 5: (1, "a"), 6: (2, "b"), 99: (3, "c"), 7: (0, None)}
    calls = spark.createDataFrame([(1, "d", "Echo", "{}"), (2, "d", "other", "{}")], "seq long, document_id string, tool string, args string")
    own = {"echo": lambda tables, rows: rows.select("seq", F.col("args").alias("result"))}
    assert [tuple(r) for r in tl.run_reads(calls, {}, own).collect()] == [(1, "echo", "{}")]


def test_a_hook_is_loaded_once_a_worker(spark, tmp_path):
    """Several batches, tasks and jobs; every load leaves a file."""
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda text: text.upper() if text != "bad" else 1 / 0

    rows = [(i, None if i % 50 == 0 else "bad" if i % 50 == 1 else f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        for _ in range(2):
            got = {r.id: r.out for r in tl.with_hook(df, "text", "out", folder, load).collect()}
            assert got == {i: None if t in (None, "bad") else t.upper() for i, t in rows}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    workers = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert workers and len(workers) == len(set(workers)) <= 8


def test_nearest_on_a_grid(spark):
    rng = random.Random(4)
    rows = [(i, "k" if i % 3 else "l", [float(rng.randint(-2, 2)) for _ in range(3 if i % 11 else 2)]) for i in range(200)]
    rows += [(500, "k", None), (501, "k", [None, 1.0, 1.0]), (502, "k", [0.0, 0.0, 0.0]), (503, "k", []), (504, "m", [1.0])]
    vectors = spark.createDataFrame(rows, "id long, label string, vector array<double>")
    targets = vectors.where("id % 10 = 0 OR id > 499")
    found = se.nearest(targets, vectors, "label", 4, block=16)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan.split("FlatMapCoGroupsInArrow")[0]
    pairs = se.similarities(targets, vectors, "label")
    best: dict = {}
    for r in sorted(pairs.collect(), key=lambda r: (r.target_id, -r.score, r.id)):
        best.setdefault(r.target_id, []).append((len(best.get(r.target_id, [])) + 1, r.id, r.score))
    expected = {(t, *x) for t, own in best.items() for x in own[:4]}
    assert {tuple(r) for r in found.collect()} == expected
    assert se.nearest(targets.limit(0), vectors, "label", 4).count() == 0


def test_spans_that_overlap(spark):
    rng = random.Random(3)
    spans = lambda n: [(rng.choice("ab"), i, a, a + rng.randint(0, 90)) for i in range(n) for a in [rng.randint(0, 400)]]
    left, right = spans(60), spans(60)
    x = spark.createDataFrame(left, "document_id string, x int, begin int, end int")
    y = spark.createDataFrame(right, "document_id string, y int, r_begin int, r_end int")
    expected = sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] < b[3] and b[2] < a[3])
    assert sorted((r.x, r.y) for r in se.overlapping(x, y, width=32).collect()) == expected


def test_times_in_both_forms(spark):
    cases = {
        "2024-02-29 12:30:00": "2024-02-29 12:30:00", "2024-02-29T12:30:00Z": "2024-02-29 12:30:00", "2024-02-29T12:30:00.250Z": "2024-02-29 12:30:00.250000", "2024-03-01T01:00:00+02:30": "2024-02-29 22:30:00",
        "2024-02-29T12:30:00-0100": "2024-02-29 13:30:00", "2024-02-29T12:30": "2024-02-29 12:30:00", "2024-13-01 00:00:00": None, "soon": None, "": None, "2024-02-29": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", tx.utc_time(F.col("t")).alias("u"))
    assert {r.t: None if r.u is None else str(r.u) for r in rows.collect()} == {**cases, None: None}

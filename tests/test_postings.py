"""The inverted index in files: files read by a search, batches in any order, and state written by streams."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_streams import run, source

from vellumspark.operators import notes as no
from vellumspark.operators import postings
from vellumspark.operators import search as se
from vellumspark.streaming import jobs

CHANGES = "document_id string, block_id string, op string, seq int, text string"


@pytest.fixture(scope="module")
def blocks(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)] + ["new", "york", "jersey"]
    rows = [(str(i % 9), f"b{i}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(300)] + [("x", "bx", "New York, New Jersey!"), ("x", "by", None)]
    return spark.createDataFrame(rows, "document_id string, block_id string, text string").cache()


def test_a_search_reads_its_terms_partitions_only(spark, blocks, tmp_path):
    path = str(tmp_path / "index")
    postings.build(blocks, path)
    whole = se.tokenise(blocks)
    for words in (["w7"], ["new", "york", "jersey"], ["absent"]):
        read = postings.tokens(spark, path, words)
        folders = {f.split("part=")[1].split("/")[0] for f in postings._read(spark, path, "postings", postings._POSTINGS, sorted({postings.part_of(w) for w in words}), 0).inputFiles()}
        scan = read._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in scan and "part" in scan.split("PartitionFilters: [")[1].split("]")[0]
        read.collect()
        files = spark.read.parquet(f"{path}/postings").where(F.col("part").isin([postings.part_of(w) for w in words])).select(F.input_file_name()).distinct().count()
        assert files <= len(words) < postings.PARTS and folders
        assert sorted(map(tuple, read.collect())) == sorted(map(tuple, whole.where(F.col("term").isin(words)).select(*read.columns).collect()))
    for query in ("new jersey", "w7 w9"):
        found = se.match(postings.tokens(spark, path, se._words(query)), query)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, se.match(whole, query).collect()))
    phrase = "new york new jersey"
    assert [r.block_id for r in se.match_phrase(postings.tokens(spark, path, se._words(phrase)), phrase).collect()] == ["bx"]
    found = se.match_prefix(postings.tokens(spark, path, [], ["w1"]), "w1")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, se.match_prefix(whole, "w1").collect()))


def test_many_batches_equal_the_last_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "PARTS", 4)
    monkeypatch.setattr(postings, "TURN", 3)
    rng, path, seq, state, late = random.Random(7), str(tmp_path / "index"), 0, {}, []
    for batch in range(8):
        rows = []
        for _ in range(rng.randint(1, 5)):
            seq += 1
            block = f"b{rng.randrange(6)}"
            op = rng.choice(["insert", "update", "delete"])
            text = None if op == "delete" else " ".join(rng.choice(["aa", "bb", "cc", "dd", "Ee"]) for _ in range(rng.randint(0, 5)))
            rows.append(("d", block, op, seq, text))
            state[block] = text
            late.append(("d", block, op, seq - 20, "late"))
        if batch == 5:
            rows += [r for r in late[:3] if all(r[1] != x[1] for x in rows)]  # older than what is known of their blocks
        for _ in range(1 + batch % 2):  # some batches run twice
            postings.apply_changes(spark, spark.createDataFrame(rows, CHANGES), path, batch)
        expected = {(b, t, i) for b, text in state.items() for i, t in enumerate((text or "").lower().split())}
        assert {(r.block_id, r.term, r.pos) for r in postings.tokens(spark, path).collect()} == expected
        assert {(r.block_id, r.pos) for r in postings.tokens(spark, path, ["cc"]).collect()} == {(b, i) for b, t, i in expected if t == "cc"}
    # superseded folders are gone: at most two turns of batches are kept of any partition
    kept = [int(p.name[6:]) for p in (tmp_path / "index" / "postings").glob("part=*/batch=*")]
    assert kept and min(kept) >= 2


def test_postings_are_sorted_in_their_tasks_not_shuffled(spark, blocks, tmp_path, monkeypatch):
    plans, write = {}, postings._write

    def seen(rows, path, kind):
        plans[kind] = rows._jdf.queryExecution().executedPlan().toString()
        write(rows, path, kind)

    monkeypatch.setattr(postings, "_write", seen)
    monkeypatch.setattr(postings, "CHARS", 2000)
    monkeypatch.setattr(postings, "SMALL_SEGMENT", 4000)
    monkeypatch.setattr(postings, "SEGMENT", 4000)
    path = str(tmp_path / "index")
    postings.build(blocks, path)
    assert "Exchange" not in plans["postings"] and plans["blocks"].count("Exchange hashpartitioning") == 1
    whole = se.tokenise(blocks)
    assert sorted(map(tuple, postings.tokens(spark, path).collect())) == sorted(map(tuple, whole.select("document_id", "block_id", "term", "pos").collect()))
    postings.apply_changes(spark, blocks.where("block_id < 'b2'").select("document_id", "block_id", F.lit("update").alias("op"), F.lit(2).alias("seq"), F.concat(F.lit("w7 w7 "), "text").alias("text")), path, 1)
    late = blocks.withColumn("text", F.when(F.col("block_id") < "b2", F.concat(F.lit("w7 w7 "), "text")).otherwise(F.col("text")))
    assert sorted(map(tuple, postings.tokens(spark, path).collect())) == sorted(map(tuple, se.tokenise(late).select("document_id", "block_id", "term", "pos").collect()))


def test_state_written_grows_with_the_batch_alone(spark, tmp_path):
    packets = [tuple(r) for r in no.packetise(spark.createDataFrame([("t", "x" * 512 * 400)], "tx string, payload string")).collect()]
    schema = "tx string, i int, n int, checksum string, data string"
    stream = jobs.stream_reassemble(source(spark, [packets[:300], packets[300:310], packets[310:320]], schema, str(tmp_path)))
    query = stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    written = [sum(s["numRowsUpdated"] for s in p["stateOperators"]) for p in query.recentProgress if p["numInputRows"]]
    assert len(written) == 3 and written[0] >= 300 and max(written[1:]) <= 12


def test_the_last_packet_of_an_index_stays(spark, tmp_path):
    schema = "tx string, i int, n int, checksum string, data string, arrival long"
    sums = {r.data: r.checksum for r in no.packetise(spark.createDataFrame([("1", "a"), ("2", "zz"), ("3", "b")], "tx string, payload string")).collect()}
    rows = [("t", 0, 2, sums["zz"], "zz", 9), ("t", 0, 2, sums["a"], "a", 1), ("t", 1, 2, sums["b"], "b", 2)]
    run(jobs.stream_reassemble(source(spark, [rows], schema, str(tmp_path))), "update", str(tmp_path))
    assert [r.payload for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["zzb"]


class _Memory:
    """State and timers of one key, as a processor sees them."""

    def __init__(self):
        self.map, self.value, self.timers, self.now = {}, None, set(), 0

    getMapState = getValueState = lambda self, *_: self  # noqa: E731, N815
    registerTimer = lambda self, at: self.timers.add(at)  # noqa: E731, N815
    deleteTimer = lambda self, at: self.timers.discard(at)  # noqa: E731, N815
    getCurrentProcessingTimeInMs = lambda self: self.now  # noqa: E731, N815
    containsKey = lambda self, k: k in self.map  # noqa: E731, N815
    updateValue = lambda self, k, v: self.map.update({k: v})  # noqa: E731, N815
    iterator = lambda self: iter(self.map.items())
    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.map, self.value = {}, None


def test_quiet_transfers_are_forgotten():
    memory, transfer = _Memory(), jobs._Transfer(1000)
    transfer.init(memory)

    def arrive(now, *packets):
        memory.now = now
        rows = pd.DataFrame([(i, 3, d) for i, d in packets], columns=["i", "n", "data"])
        return next(transfer.handleInputRows(("t",), iter([rows]), memory)).iloc[0].tolist()[1:]

    assert arrive(5, (0, "a")) == [100 / 3, None] and memory.timers == {1005}
    assert arrive(900, (1, "b"), (0, "A")) == [200 / 3, None] and memory.timers == {1900}
    assert list(transfer.handleExpiredTimer(("t",), memory, None)) == [] and not memory.map and memory.value is None
    assert arrive(2000, (2, "c")) == [100 / 3, None]
    assert arrive(2001, (0, "a"), (1, "b")) == [100.0, "abc"]

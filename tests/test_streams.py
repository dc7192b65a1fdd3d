"""Streaming operators against their batch twins, over several micro-batches."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from vellumspark.functions import text as tx
from vellumspark.operators import notes as no
from vellumspark.operators import postings
from vellumspark.operators import toolog as tl
from vellumspark.operators.search import tokenise
from vellumspark.session import ship
from vellumspark.streaming import jobs


def run(stream, mode, path):
    def keep(df, epoch):
        df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/out/e={epoch}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def source(spark, batches, schema, path):
    """One file a batch, in order of time."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/in")


def test_packets_over_batches(spark, tmp_path):
    payloads = spark.createDataFrame([("t", "A" * 1200), ("u", "é" * 300)], "tx string, payload string")
    packets = [tuple(r) for r in no.packetise(payloads).collect()]
    schema = "tx string, i int, n int, checksum string, data string"
    bad = [(tx, i, n, c, "damaged") for tx, i, n, c, _ in packets if tx == "u"][:1]
    stream = source(spark, [packets[::2], bad, packets[1::2], packets[:1]], schema, str(tmp_path))
    run(jobs.stream_reassemble(stream), "update", str(tmp_path))
    out = spark.read.parquet(f"{tmp_path}/out").groupBy("tx").agg(F.max(F.struct("progress", "payload")).alias("r"))
    assert {r.tx: r.r.payload for r in out.collect()} == {"t": "A" * 1200, "u": "é" * 300}


def test_streaks_over_batches(spark, tmp_path):
    schema = "session_id string, ts int, seq long, failed boolean"
    rows = [("s", i, i, f) for i, f in enumerate([True, True, False, True, True, True])] + [("t", 0, 0, True)]
    stream = source(spark, [rows[:3], rows[3:]], schema, str(tmp_path))
    run(jobs.stream_streaks(stream), "append", str(tmp_path))
    got = {(r.session_id, r.seq): r.streak for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    twin = {(r.session_id, r.seq): r.streak for r in tl.failure_streaks(spark.createDataFrame(rows, schema)).collect()}
    assert got == twin


def test_index_over_batches(spark, tmp_path):
    schema = "document_id string, block_id string, op string, seq int, text string"
    first = [("d", "a", "insert", 1, "one two"), ("d", "b", "insert", 2, "three"), ("d", "c", "insert", 3, "four")]
    second = [("d", "a", "update", 4, "five six"), ("d", "b", "delete", 5, None), ("d", "a", "update", 6, "seven")]
    for n, rows in enumerate([first, second]):
        postings.apply_changes(spark, spark.createDataFrame(rows, schema), str(tmp_path / "index"), n)
        postings.apply_changes(spark, spark.createDataFrame(rows, schema), str(tmp_path / "index"), n)  # a batch that runs again
    final = tokenise(spark.createDataFrame([("d", "a", "seven"), ("d", "c", "four")], "document_id string, block_id string, text string"))
    got = jobs.latest_snapshot(spark, str(tmp_path / "index"))
    assert {tuple(r) for r in got.select("block_id", "term", "pos").collect()} == {tuple(r) for r in final.select("block_id", "term", "pos").collect()}


def test_streaks_of_many_sessions_share_state(spark, tmp_path):
    schema = "session_id string, ts int, seq long, failed boolean"
    rows = [(None if k == 7 else f"s{k}", t, 10 * k + t, (k * 7 + t * t) % 5 != 0) for k in range(3000) for t in range(6)]
    stream = jobs.stream_streaks(source(spark, [[r for r in rows if r[1] // 2 == n][::-1] for n in range(3)], schema, str(tmp_path)))

    def keep(df, epoch):
        df.write.mode("overwrite").parquet(f"{tmp_path}/out/e={epoch}")

    query = stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    written = [sum(s["numRowsUpdated"] for s in p["stateOperators"]) for p in query.recentProgress if p["numInputRows"]]
    assert len(written) == 3 and max(written) <= 1024
    got = {(r.session_id, r.seq): r.streak for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == len(rows)
    assert got == {(r.session_id, r.seq): r.streak for r in tl.failure_streaks(spark.createDataFrame(rows, schema)).collect()}


def test_whole_transfers_are_one_value(spark, tmp_path):
    schema = "tx string, i int, n int, checksum string, data string"
    sums = {r.data: r.checksum for r in no.packetise(spark.createDataFrame([(c, c) for c in "abcdéxyz"], "tx string, payload string")).collect()}
    packet = lambda tx, i, n, c: (tx, i, n, sums[c], c)
    t = [packet("t", i, 90, "abcdé"[i % 5]) for i in range(90)]
    batches = [t[::-1] + [packet("u", 0, 2, "x")], [packet("t", 4, 90, "z"), packet("u", 1, 2, "y")], [packet("t", 95, 90, "x")], [packet("t", 0, 90, "y"), packet("u", 0, 3, "z")]]
    stream = jobs.stream_reassemble(source(spark, batches, schema, str(tmp_path)))

    def keep(df, epoch):
        df.write.mode("overwrite").parquet(f"{tmp_path}/out/e={epoch}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    written = [sum(s["numRowsUpdated"] for s in p["stateOperators"]) for p in query.recentProgress if p["numInputRows"]]
    assert len(written) == 4 and max(written[:2]) <= 4
    held, expected = {}, {}
    for e, rows in enumerate(batches):
        for tx, i, n, _, data in rows:
            held.setdefault(tx, {})[i] = data
            have = held[tx]
            expected[e, tx] = (len(have) * 100.0 / n, "".join(have[k] for k in range(n)) if all(k in have for k in range(n)) else None)
    assert {(r.e, r.tx): (r.progress, r.payload) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == expected


def test_packet_checksums_are_the_checksums(spark, monkeypatch):
    texts = ["", None, "a", "é😀|" * 300, "x" * 512, "\x00\x00", "tail\x00", "￿"] + ["w" * (k % 40) for k in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, data string").coalesce(1)
    ship(spark)
    both = rows.select("id", tx.checksum(F.col("data")).alias("old"), tx.packet_checksum(F.col("data")).alias("new")).collect()
    assert len(both) == len(texts) and all(r.old == r.new for r in both)
    monkeypatch.setattr(tx, "_CELLS", 700)  # blocks of few texts, and texts longer than a block
    raw = pd.Series([None if t is None else t.encode("utf-32-be") for t in texts])
    assert tx._checksums(raw).tolist() == [r.old for r in sorted(both)]
    assert tx._checksums(raw[:0]).tolist() == []


def test_packets_of_a_stream_are_checked_in_blocks(spark, tmp_path):
    stream = source(spark, [[("t", 0, 1, "0", "a")]], "tx string, i int, n int, checksum string, data string", str(tmp_path))
    assert "aggregate(" not in jobs.stream_reassemble(stream)._jdf.queryExecution().analyzed().toString()


def test_every_document_is_reassembled(spark, tmp_path):
    """Null and empty texts, null and repeated ids: a row for every document, as the SQL has it."""
    from oracle import rows

    from vellumspark.plans import records

    docs = [(1, "é😀|" * 300), (1, "of the same id"), (2, "twice"), (2, "twice"), (3, ""), (4, None), (None, "no id"), (None, "x" * 513), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = records.QUERIES["t2_stream_reassemble"](spark, str(tmp_path)).toPandas()
    expected = duckdb.sql(records.ORACLE["t2_stream_reassemble"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).df()
    assert rows(found) == rows(expected)

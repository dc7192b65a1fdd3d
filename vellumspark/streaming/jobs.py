"""Streaming twins: incremental index maintenance, packet reassembly, failure streaks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellumspark.functions.text import packet_checksum
from vellumspark.operators import postings
from vellumspark.session import ship

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_snapshot(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The token index [document_id, block_id, term, pos] after its last batch, or after the last before an epoch; None if there is none."""
    last = postings.finished(spark, path)
    if (last if before is None else min(last, before - 1)) < 0:
        return None
    return postings.tokens(spark, path, before=before)


def stream_index(changes: DataFrame, path: str, checkpoint: str):
    """Keeps the inverted index at ``path`` up to date with a stream of block changes [document_id, block_id, op, seq, text]."""

    def batch(df: DataFrame, epoch: int) -> None:
        postings.apply_changes(df.sparkSession, df, path, epoch)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _keyed(rows: DataFrame) -> DataFrame:
    """The input of an operator with keyed state, whose kinds of state need the RocksDB store."""
    ship(rows.sparkSession)
    rows.sparkSession.conf.set(_STORE, _ROCKS)
    return rows


class _Transfer(StatefulProcessor):
    """Packets of a transfer by index, and how many there are; a timer clears what got no packet for long.

    Every call of the state costs more than the packet it is for. A transfer that comes at once is therefore
    one value, which is read and written when its payload is put out; only others have a row for every packet.
    """

    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "i int", "data string")
        self.count = handle.getValueState("count", "n int, got int, until long, whole array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.count.get() if self.count.exists() else None
        n, got, until, whole = known or (0, 0, 0, None)
        frames = list(rows)
        arrived = pd.concat(frames) if len(frames) > 1 else frames[0]
        if "arrival" in arrived:
            arrived = arrived.sort_values("arrival", kind="stable")
        fresh = dict(zip(arrived["i"].tolist(), arrived["data"].tolist(), strict=True))
        total = int(arrived["n"].iloc[-1])
        if whole and (total != n or not all(0 <= i < n for i in fresh)):
            # a packet that such a transfer has no place for: its packets become rows
            for i, data in enumerate(whole):
                self.parts.updateValue((i,), (data,))
            whole = None
        n = total
        if whole:
            whole = [fresh.get(i, data) for i, data in enumerate(whole)]
        elif not known and len(fresh) == n and all(i in fresh for i in range(n)):
            got, whole = n, [fresh[i] for i in range(n)]
        else:
            for i, data in fresh.items():
                got += not (known and self.parts.containsKey((i,)))
                self.parts.updateValue((i,), (data,))
        if self.timeout_ms:
            if until:
                self.handle.deleteTimer(until)
            until = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.handle.registerTimer(until)
        self.count.update((n, got, until, whole))
        payload = "".join(whole) if whole else None
        if got >= n and not whole:
            have = {i: data for (i,), (data,) in self.parts.iterator()}
            payload = "".join(have[i] for i in range(n)) if all(i in have for i in range(n)) else None
        yield pd.DataFrame({"tx": [key[0]], "progress": [got * 100.0 / n], "payload": [payload]}, copy=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.parts.clear()
        self.count.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_reassemble(packets: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """[tx, progress, payload] after every batch; bad checksums are dropped, duplicates overwrite.

    A batch writes the state of its own packets alone, or of a transfer that it puts out again. Of one index in one batch the packet with the
    highest ``arrival`` stays, where there is such a column. The state of a transfer stays for ever,
    or until it got no packet for ``timeout_ms``.
    """
    good = _keyed(packets).where(packet_checksum(F.col("data")) == F.col("checksum")).withColumn("tx", F.col("tx").cast("string"))
    good = good.select("tx", *[c for c in ("i", "n", "data", "arrival") if c in packets.columns])
    mode = "ProcessingTime" if timeout_ms else "None"
    return good.groupBy("tx").transformWithStateInPandas(_Transfer(timeout_ms), "tx string, progress double, payload string", "Update", mode)


#: Keys of the streaks' state; sessions share them, as a call for every session costs more than its rows.
_STREAK_KEYS = 1024


def _streaks(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Failures in a row of the sessions of one key; the state holds the sessions whose last result failed."""
    held = dict(zip(*state.get, strict=True)) if state.exists else {}
    arrived = pd.concat(list(rows))
    session, names = pd.factorize(arrived["session_id"], use_na_sentinel=False)
    names = [None if pd.isna(name) else name for name in names]
    order = np.lexsort((arrived["seq"].to_numpy(), arrived["ts"].to_numpy(), session))
    session, failed, at = session[order], arrived["failed"].to_numpy()[order].astype(bool), np.arange(len(order))
    first = np.flatnonzero(np.diff(session, prepend=-1))
    passed, before = np.maximum.accumulate(np.where(failed, -1, at)), np.array([held.get(name, 0) for name in names])
    streak = at - np.where(passed >= first[session], passed, (first - 1 - before)[session])
    held |= dict(zip(names, streak[np.append(first[1:], len(order)) - 1].tolist(), strict=True))
    held = {name: n for name, n in held.items() if n}
    state.update((list(held), list(held.values())))
    yield pd.DataFrame({"session_id": np.array(names, dtype=object)[session], "seq": arrived["seq"].to_numpy()[order], "streak": streak})


def stream_streaks(results: DataFrame) -> DataFrame:
    """[session_id, seq, streak] of a stream of tool results, in order of time within each batch.

    A batch writes the state of the keys that its sessions fall to, which is their sessions in a streak.
    """
    session = F.col("session_id").cast("string")
    keyed = _keyed(results).select(session.alias("session_id"), "ts", "seq", "failed", F.pmod(F.xxhash64(session), F.lit(_STREAK_KEYS)).alias("key"))
    return keyed.groupBy("key").applyInPandasWithState(_streaks, "session_id string, seq long, streak long", "sessions array<string>, streaks array<long>", "append", GroupStateTimeout.NoTimeout)

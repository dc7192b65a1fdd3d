"""Packing of documents into sequences of bounded length by Karmarkar-Karp differencing.

Documents are tokenised and cut where a full sequence ends: full pieces are sequences of their
own, and every document has at most one shorter rest. Rests are dealt by a hash to groups of
bounded expected size, and each group is packed by multiway differencing: every rest starts as
a partial partition (one filled window, the others empty); the two partitions with the largest
imbalance are merged, fullest windows with emptiest ones, until one near-equal partition is
left. If its fullest window exceeds the capacity, the number of windows rises and the group is
partitioned again. Rests above half a sequence are halved first: more and smaller parts make
the differencing converge to nearly full windows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm import textblock as tb
from vellumspark.llm.bytepair import Encoder
from vellumspark.session import materialise, ship

#: Id that ends every document.
END_ID = 1
#: Rests in a packing group, on average.
GROUP_ROWS = 500


@tb.tidied
def _pieces(batches: Iterator[pa.RecordBatch], path: str, ranks: str | None, capacity: int, part: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(path, ranks)
    for batch in batches:
        for block in tb.blocks(batch.column(1)):
            ids, counts = encoder.encode(block)
            total = counts + 1
            flat = np.full(int(total.sum()), END_ID, np.uint32)
            keep = np.ones(len(flat), bool)
            keep[np.cumsum(total) - 1] = False
            flat[keep] = ids
            raw = flat.astype("<u4").tobytes()
            row, start, length, crc = [], [], [], []
            offset = 0
            for i, n in enumerate(total.tolist()):
                at = 0
                while at < n:
                    left = n - at
                    size = capacity if left >= capacity else left if left <= part else (left + 1) // 2 if left <= 2 * part else part
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(raw[4 * (offset + at) : 4 * (offset + at + size)]))
                    at += size
                offset += n
            row = np.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.first, block.n).take(pa.array(row)), *[pa.array(x, pa.int64()) for x in (start, length, crc)], pa.array(total[row].astype(np.int64))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """(window of each size, sum of the fullest window) of a k-way Karmarkar-Karp partition."""
    n = len(sizes)
    left, right = np.full(n, -1), np.full(n, -1)
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i, x in enumerate(sizes.tolist()):
        sums, slots = np.zeros(k, np.int64), np.full(k, -1)
        sums[-1], slots[-1] = x, i
        heap.append((-x, i, sums, slots))
    heapq.heapify(heap)
    children = [np.column_stack([left, right])]
    made = n
    while len(heap) > 1:
        _, tie, sums, slots = heapq.heappop(heap)
        _, _, other, taken = heapq.heappop(heap)
        sums, taken = sums + other[::-1], taken[::-1]
        both = (slots >= 0) & (taken >= 0)
        merged = np.where(slots >= 0, slots, taken)
        count = int(both.sum())
        if count:
            children.append(np.column_stack([slots[both], taken[both]]))
            merged[both] = made + np.arange(count)
            made += count
        order = np.argsort(sums, kind="stable")
        sums, slots = sums[order], merged[order]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), tie, sums, slots))
    _, _, sums, slots = heap[0]
    tree = np.concatenate(children)
    window = np.full(made, -1)
    used = slots >= 0
    window[slots[used]] = np.flatnonzero(used)
    for node in range(made - 1, n - 1, -1):
        window[tree[node]] = window[node]
    return window[:n], int(sums[-1])


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each size, no window above the capacity; sizes are at most the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, most = differencing(sizes, k)
        if most <= capacity:
            return window
        k += max(1, int(k * min(0.02, (most - capacity) / capacity / 4)))


def _group(key: tuple, rows: pa.Table, capacity: int) -> pa.Table:
    """Windows of one group; ids stay in Arrow, as they came."""
    order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
    rows = rows.drop_columns(["_group"]).sort_by(order).combine_chunks()
    sizes = rows["length"].to_numpy()
    full = sizes == capacity
    window = np.zeros(len(sizes), np.int64)
    window[full] = np.arange(full.sum())
    if (~full).any():
        window[~full] = pack_sizes(sizes[~full], capacity) + full.sum()
    by = np.lexsort((-sizes, window))
    window, sizes = window[by], sizes[by]
    through = np.cumsum(sizes)
    first = np.searchsorted(window, window)
    offset = through - sizes - (through - sizes)[first]
    return rows.take(pa.array(by)).append_column("sequence_id", pa.array((key[0].as_py() << 32) + window)).append_column("offset", pa.array(offset))


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = 2048, parts: int = 2) -> DataFrame:
    """Pieces of all documents: [doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset].

    ``vocabulary`` is a ``tokenizers`` file, by its place on the workers or its name in
    ``public_tokenizers``; ``ranks`` may name the same vocabulary for ``tiktoken``. Rests above ``capacity / parts`` ids are halved.

    Defined cases: a null text counts as empty and is one id; repeated rows and repeated or
    null ids are documents of their own; a document of any length is cut; ties are broken by
    id, start and checksum; an empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    cut = partial(_pieces, path=vocabulary, ranks=ranks, capacity=capacity, part=capacity // parts)
    pieces = materialise(docs.select("doc_id", "text").mapInArrow(cut, schema), "pieces")
    n = pieces.count()
    groups = max(1, n // GROUP_ROWS)
    # equal rows would share a hash; their number in the table may be anything, so the checksum
    # and the row's own random-free position spread them
    salted = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def windows(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return _group(key, rows, capacity)

    return salted.groupBy("_group").applyInArrow(windows, schema + ", sequence_id bigint, offset bigint")


def op4_pack(spark, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), "byte_bpe_50k.json", "byte_bpe_50k.tiktoken")

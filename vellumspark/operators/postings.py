"""An inverted index in files: posting lists by term, kept up to date by batches of block changes.

``postings`` holds [term, document_id, block_id, seq, positions] in partitions of the term's hash and
of the batch; ``blocks`` holds every block's terms in partitions of the block's hash. A batch looks
up the former terms of its own blocks only, and writes a posting without positions where a block
has lost a term. So a search reads the partitions of its terms and nothing else: the newest
posting of a term and block counts. Each batch also merges a few partitions (in turn, all of
them within ``TURN`` batches), by overwriting exactly those; what they held before is deleted a
turn later, when no reader of an earlier batch needs it.

Texts are shuffled once, into as many buckets of blocks as their characters need. Postings are not
shuffled: a task reads at most ``SEGMENT`` bytes of blocks, sorts their postings in memory and adds
a file to each partition, so a partition of a large batch has several files, each in order of terms.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumspark.functions.text import terms as folded_terms

#: Hash partitions of terms and of blocks; fixed for an index once it is written.
PARTS = 32
#: Batches within which every partition is merged once.
TURN = 16
#: Characters of text that a task takes in a shuffle, at most and (where there are idle cores) at least.
CHARS, FEW_CHARS = 12_000_000, 1_000_000
#: Bytes of blocks' files whose postings one task sorts, at most and (where there are idle cores) at least.
SEGMENT, SMALL_SEGMENT = 8 << 20, 1 << 20
#: Bytes of a partition's files that a task merges.
MERGED = 16 << 20

_TERMS = "array<string>"
_ENTRIES = "array<struct<term: string, positions: array<int>>>"
_BLOCKS = f"block_id string, document_id string, seq bigint, terms {_TERMS}, gone {_TERMS}, own boolean, part int, batch int"
_POSTINGS = "term string, document_id string, block_id string, seq bigint, positions array<int>, part int, batch int"


def _part(key: Column) -> Column:
    return (F.crc32(key.cast("binary")) % PARTS).cast("int")


def _files(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def finished(spark: SparkSession, path: str) -> int:
    """Number of the last finished batch, -1 without any."""
    fs, root = _files(spark, f"{path}/done")
    return max([int(s.getPath().getName()) for s in fs.listStatus(root)], default=-1) if fs.exists(root) else -1


def _whole_at(part: int, batch: int) -> int:
    """The last batch up to ``batch`` that merged a partition; 0 if none did, as nothing is older."""
    return max(batch - (batch - part) % TURN, 0)


def _read(spark: SparkSession, path: str, kind: str, schema: str, parts: list[int], batch: int) -> DataFrame:
    """Rows of some partitions as of a batch: those since each was merged last."""
    fs, root = _files(spark, f"{path}/{kind}")
    if batch < 0 or not parts or not fs.exists(root):
        return spark.createDataFrame([], schema)
    since: dict[int, list[int]] = {}
    for p in parts:
        since.setdefault(_whole_at(p, batch), []).append(p)
    wanted = F.lit(False)
    for first, some in since.items():
        wanted = wanted | (F.col("part").isin(some) & (F.col("batch") >= first))
    return spark.read.schema(schema).parquet(f"{path}/{kind}").where((F.col("batch") <= batch) & wanted)


def _newest(rows: DataFrame, *keys: str) -> DataFrame:
    """The row with the highest change number of each key; a later batch wins a tie."""
    order = Window.partitionBy(*keys).orderBy(F.desc("seq"), F.desc("batch"))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def _length(spark: SparkSession, path: str, kind: str, parts: list[int], since: int, batch: int) -> int:
    """Bytes of some partitions' files of a range of batches."""
    fs, root = _files(spark, f"{path}/{kind}/part={{{','.join(map(str, parts))}}}/batch=*")
    folders = [s for s in (fs.globStatus(root) or []) if since <= int(s.getPath().getName()[6:]) <= batch]
    return sum(f.getLen() for s in folders for f in fs.listStatus(s.getPath()))


def _merge(rows: DataFrame, key: str, parts: list[int], length: int, *keys: str) -> DataFrame:
    """The newest rows of whole partitions, dealt by a hash of a key into tasks of about ``MERGED`` bytes."""
    each = -(-length // (len(parts) * MERGED)) or 1
    dealt = rows.withColumn("_b", (F.crc32(F.col(key).cast("binary")) / PARTS).cast("long") % each).repartition(len(parts) * each, "part", "_b")
    return _newest(dealt, "part", "_b", *keys).drop("_b")


def _write(rows: DataFrame, path: str, kind: str) -> None:
    """Replaces exactly the (partition, batch) folders that have rows, so a batch may run again."""
    ordered = rows.sortWithinPartitions("part", "batch", rows.columns[0])
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("part", "batch").parquet(f"{path}/{kind}")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """A value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _postings_of(terms: Column) -> Column:
    """A block's distinct terms in order, each with its positions: an array of structs [term, positions]."""

    def grouped(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - 1)["term"]))

        def one(starts: Column) -> Column:
            def entry(start: Column, j: Column) -> Column:
                positions = F.transform(F.slice(s, start + 1, F.coalesce(F.get(starts, j + 1), F.size(s)) - start), lambda x: x["at"])
                return F.struct(F.get(s, start)["term"].alias("term"), positions.alias("positions"))

            return F.transform(starts, entry)

        return _let(starts, one)

    pairs = F.sort_array(F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("at"))))
    return F.when(F.size(terms) > 0, _let(pairs, grouped)).otherwise(F.array().cast(_ENTRIES))


def _segments(spark: SparkSession, length: int) -> SparkSession:
    """A session of its own whose tasks read about ``SEGMENT`` bytes of files."""
    own = spark.newSession()
    task = max(SMALL_SEGMENT, min(SEGMENT, length // spark.sparkContext.defaultParallelism))
    for key, value in {"maxPartitionBytes": task, "openCostInBytes": 1 << 14, "minPartitionNum": 1}.items():
        own.conf.set(f"spark.sql.files.{key}", str(value))
    return own


def _forget(spark: SparkSession, path: str, kind: str, part: int, before: int) -> None:
    """Deletes a partition's folders of batches before a number."""
    fs, root = _files(spark, f"{path}/{kind}/part={part}")
    if fs.exists(root):
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("batch=") and int(name[6:]) < before:
                fs.delete(status.getPath(), True)


def apply_changes(spark: SparkSession, changes: DataFrame, path: str, batch: int) -> None:
    """One batch of block changes [document_id, block_id, op, seq, text]: of a block the highest number wins.

    ``op`` is insert, update or delete. Batches are numbered 0, 1, 2, ...; one that runs again
    writes the same files.
    """
    merged = [p for p in range(PARTS) if p % TURN == batch % TURN] if batch else []
    now, hashed = F.lit(batch).alias("batch"), F.crc32(F.col("block_id").cast("binary"))
    size = changes.agg(F.sum(F.length("text")), F.collect_set(_part(F.col("block_id")))).first()
    parts, chars = sorted(size[1]), size[0] or 0
    # buckets divide or multiply the partitions, so a bucket's rows go to few of these
    tasks = max(-(-chars // CHARS), min(spark.sparkContext.defaultParallelism, chars // FEW_CHARS), 1)
    buckets = -(-tasks // PARTS) * PARTS if tasks > PARTS else next(n for n in range(tasks, PARTS + 1) if PARTS % n == 0)
    dealt = changes.withColumn("_b", hashed % buckets).repartition(buckets, "_b")
    order = Window.partitionBy("_b", "block_id").orderBy(F.desc("seq"), F.desc("op"), F.desc("text"))
    last = dealt.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    none = F.array().cast(_TERMS)
    terms = F.when(F.col("op") == "delete", none).otherwise(F.coalesce(folded_terms(F.col("text")), none))
    fresh = last.select("block_id", "document_id", F.col("seq").cast("long").alias("seq"), terms.alias("terms"), _part(F.col("block_id")).alias("part"))

    # a block's former terms; a change older than what is known of its block is dropped
    if batch:
        former = _newest(_read(spark, path, "blocks", _BLOCKS, parts, batch - 1), "block_id").select("block_id", F.col("seq").alias("_seq"), F.col("terms").alias("_terms"))
        fresh = fresh.join(former.hint("merge"), "block_id", "left").where("_seq IS NULL OR seq >= _seq")
        gone = F.array_except(F.coalesce("_terms", none), "terms")
    else:
        gone = none
    fresh = fresh.select("block_id", "document_id", "seq", "terms", gone.alias("gone"), F.lit(True).alias("own"), "part", now)
    if batch:
        fresh = fresh.withColumn("_b", hashed % buckets).repartition(buckets, "_b").drop("_b")
    if merged:
        # partitions whose turn it is are written whole, without what is superseded
        older = _read(spark, path, "blocks", _BLOCKS, merged, batch - 1).withColumn("own", F.lit(False))
        length = _length(spark, path, "blocks", merged, batch - TURN, batch - 1)
        whole = _merge(older.unionByName(fresh.where(F.col("part").isin(merged))), "block_id", merged, length, "block_id").withColumn("batch", F.lit(batch))
        fresh = fresh.where(~F.col("part").isin(merged)).unionByName(whole)
    _write(fresh, path, "blocks")

    length = _length(spark, path, "blocks", parts, batch, batch) if parts else 0
    own = _segments(spark, length).read.schema(_BLOCKS).parquet(f"{path}/blocks").where((F.col("batch") == batch) & F.col("own"))
    lost = F.transform("gone", lambda t: F.struct(t.alias("term"), F.array().cast("array<int>").alias("positions")))
    rows = own.select("document_id", "block_id", "seq", F.explode_outer(F.concat(_postings_of(F.col("terms")), lost)).alias("e")).where("e IS NOT NULL")
    rows = rows.select("e.term", "document_id", "block_id", "seq", "e.positions").withColumn("part", _part(F.col("term"))).withColumn("batch", F.lit(batch))
    if merged:
        older = _read(own.sparkSession, path, "postings", _POSTINGS, merged, batch - 1)
        length = _length(spark, path, "postings", merged, batch - TURN, batch - 1)
        whole = _merge(older.unionByName(rows.where(F.col("part").isin(merged))), "term", merged, length, "term", "block_id").where(F.size("positions") > 0).withColumn("batch", F.lit(batch))
        rows = rows.where(~F.col("part").isin(merged)).unionByName(whole)
    _write(rows, path, "postings")
    fs, root = _files(spark, f"{path}/done/{batch}")
    fs.create(root, True).close()
    for part in merged:
        for kind in ("postings", "blocks"):
            _forget(spark, path, kind, part, batch - TURN)


def part_of(term: str) -> int:
    """The partition of a term."""
    return zlib.crc32(term.encode()) % PARTS


def postings(spark: SparkSession, path: str, words: list[str] | None = None, prefixes: list[str] | None = None, before: int | None = None) -> DataFrame:
    """[term, document_id, block_id, positions] of some words, and of all terms with some prefixes; of all terms without both.

    Words read their own partitions only; a prefix reads all of them, with the filter at the scan.
    ``before`` gives the index as of the batches before that number.
    """
    batch = finished(spark, path) if before is None else before - 1
    if words is None and not prefixes:
        rows = _read(spark, path, "postings", _POSTINGS, list(range(PARTS)), batch)
    else:
        some, wanted = sorted({part_of(w) for w in words or []}), F.col("term").isin(words or [])
        for prefix in prefixes or []:
            some, wanted = list(range(PARTS)), wanted | F.col("term").startswith(prefix)
        rows = _read(spark, path, "postings", _POSTINGS, some, batch).where(wanted)
    if batch > 0:
        rows = _newest(rows, "part", "term", "block_id")  # of one batch each term and block has one posting
    return rows.where(F.size("positions") > 0).select("term", "document_id", "block_id", "positions")


def tokens(spark: SparkSession, path: str, words: list[str] | None = None, prefixes: list[str] | None = None, before: int | None = None) -> DataFrame:
    """The same as token rows [document_id, block_id, term, pos], as the search operators read them."""
    return postings(spark, path, words, prefixes, before).select("document_id", "block_id", "term", F.explode("positions").alias("pos"))


def build(blocks: DataFrame, path: str) -> None:
    """A new index of blocks [document_id, block_id, text]."""
    apply_changes(blocks.sparkSession, blocks.select("document_id", "block_id", F.lit("insert").alias("op"), F.lit(1).alias("seq"), "text"), path, 0)

"""Session helpers: table loading and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is ``spark.checkpoint.dir`` (or the checkpoint directory already set on the
    context). Only where neither is set and the master is local, as in tests, a temporary
    folder is made; on a cluster that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="vellumspark-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def lowest_hashes(rows: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """The ``most`` rows with the lowest hashes of a distinct key: a sample that depends on the keys alone.

    Hashes are cut off at a bound that leaves some more rows than wanted, so that the final
    sort gathers about ``most`` rows however many there are.
    """
    n, rank = rows.count(), F.xxhash64(F.lit(seed), F.col(key))
    wanted = 1.2 * most + 200
    near = rows.where(rank < int(-(2**63) + 2**64 * (wanted / n))) if n > wanted else rows
    return near.orderBy(rank, key).limit(most)


def spread(df: DataFrame, size: Column, most: int, *keys: str) -> DataFrame:
    """Rows dealt by keys into tasks that take about ``most`` of a size.

    The number of tasks is set from the sum of the size, as Spark joins partitions by the bytes that
    arrive, which may be few before rows grow.
    """
    total = df.agg(F.sum(size)).first()[0] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-total // most)), *keys)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back.

    This cuts the lineage, survives lost executors and gives the readers real size
    statistics, so that later joins are planned on measured sizes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers (once per context)."""
    context = spark.sparkContext
    if getattr(context, "_vellumspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="vellumspark-"), "vellumspark.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(target)
    context._vellumspark_shipped = True

"""Sources: text corpora by format, JSON records with rejects, image assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats by file extension.
FORMATS = {"md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "txt": "text"}


def scan_corpus(spark: SparkSession, paths: list[str] | str) -> tuple[DataFrame, DataFrame]:
    """([path, format, text], rejects [path, reason]) of text files, by extension whatever its case."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    named = files.withColumn("format", F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])[extension])
    good = named.where("format IS NOT NULL").select("path", "format", "text")
    return good, named.where("format IS NULL").select("path", F.concat(F.lit("unsupported format: "), extension).alias("reason"))


def read_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good records, bad [raw, error]) of JSON lines with a declared schema."""
    rows = spark.read.text(path).select("value")
    parsed = rows.select("value", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    fine = F.col("r").isNotNull() & F.col("r._bad").isNull()
    return parsed.where(fine).select("r.*").drop("_bad"), parsed.where(~fine).select(F.col("value").alias("raw"), F.lit("invalid record").alias("error"))


def scan_assets(spark: SparkSession, path: str) -> DataFrame:
    """[path, sha256, image_id, local_uri] of image files."""
    files = spark.read.format("binaryFile").load(path)
    image = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    digest = F.sha2("content", 256)
    return files.select("path", digest.alias("sha256"), image.alias("image_id"), F.concat(F.lit("local-asset://"), digest, F.lit("_"), image, F.lit(".png")).alias("local_uri"))


def register(tables: dict[str, DataFrame]) -> None:
    """Names tables as views, for ad hoc SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, query: str) -> DataFrame:
    """Rows of an ad hoc SELECT as JSON: [json].

    The text is read as a subquery, where Spark's grammar has no commands: no INSERT, also behind WITH.
    """
    from vellumspark.operators.store import json_rows

    if not query.lstrip().lower().startswith(("select", "with")):
        raise ValueError("only SELECT statements are run")
    return json_rows(spark.sql(f"SELECT * FROM (\n{query.strip().rstrip(';')}\n)"))

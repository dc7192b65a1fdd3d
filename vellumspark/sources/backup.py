"""Backups of annotations as files: a sink, and a source that takes older and damaged payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version that is written; sources read it and all before.
SCHEMA_VERSION = 2
#: Folders that documents are dealt to.
PARTS = 64

_NOTE = ("annotation_type", "color_code", "highlighted_text", "note_body", "anchor_metadata", "created_at", "updated_at", "author_id")
_DOCUMENT = ("title", "author", "source_type", "sha256_hash", "metadata")
_SCHEMA = (
    f"schema_version int, document struct<{', '.join(f'{c}: string' for c in _DOCUMENT)}>, "
    f"annotations array<struct<id: string, {', '.join(f'{c}: string' for c in _NOTE)}, tags: array<string>>>"
)


def _column(df: DataFrame, name: str):
    return (F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")).alias(name)


def payloads(documents: DataFrame, annotations: DataFrame, tags: DataFrame) -> DataFrame:
    """[document_id, payload_json] of every document, also of one without annotations.

    ``annotations`` have document_id, id and any columns of a payload's annotation, ``tags`` [annotation_id, name]. Annotations
    are in order of id, tags in order of name; columns that a table lacks are left out of its payloads.
    """
    named = tags.groupBy(F.col("annotation_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("tags"))
    notes = annotations.select("document_id", F.col("id").cast("string").alias("id"), *[_column(annotations, c) for c in _NOTE])
    notes = notes.join(named.hint("merge"), "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    listed = notes.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("id", *_NOTE, "tags"))).alias("annotations"))
    joined = documents.select("document_id", F.struct(*[_column(documents, c) for c in _DOCUMENT]).alias("document")).join(listed.hint("merge"), "document_id", "left")
    held = F.coalesce("annotations", F.array().cast(dict(listed.dtypes)["annotations"]))
    return joined.select("document_id", F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "document", held.alias("annotations"))).alias("payload_json"))


def write(rows: DataFrame, path: str) -> None:
    """Writes payloads [document_id, payload_json], a document a line, in folders by the hash of the document."""
    part = F.pmod(F.xxhash64("document_id"), F.lit(PARTS)).alias("part")
    line = F.to_json(F.struct(F.col("document_id").cast("string").alias("document_id"), F.col("payload_json").alias("payload")))
    rows.select(part, line.alias("value")).repartition("part").write.partitionBy("part").text(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, annotations, rejects) of the files of a backup.

    ``documents`` [document_id, schema_version, title, ...], ``annotations`` [document_id, id, ..., tags]; a payload of an
    earlier version has no tags (an empty list), one without a version is of the first. Unknown fields are
    ignored. ``rejects`` [value, reason]: ``damaged`` is no JSON, ``no document`` has no document or no hash of one, ``newer``
    is of a later version than this one. Annotations without an id are left out.
    """
    lines = spark.read.text(path).select("value")
    outer = F.from_json("value", "document_id string, payload string")
    read_ = lines.withColumns({"o": outer, "json": F.try_parse_json("value")}).withColumn("p", F.from_json("o.payload", _SCHEMA)).withColumn("inner", F.try_parse_json("o.payload"))
    version = F.coalesce("p.schema_version", F.lit(1))
    damaged = F.col("json").isNull() | F.col("inner").isNull()
    reason = F.when(damaged, "damaged").when(version > SCHEMA_VERSION, "newer").when(F.col("p.document.sha256_hash").isNull() | F.col("o.document_id").isNull(), "no document")
    judged = read_.select("value", reason.alias("reason"), F.col("o.document_id").alias("document_id"), version.alias("schema_version"), "p")
    good = judged.where("reason IS NULL")
    notes = good.select("document_id", F.explode("p.annotations").alias("a")).where("a.id IS NOT NULL")
    tags = F.coalesce("a.tags", F.array().cast("array<string>"))
    return (
        good.select("document_id", "schema_version", "p.document.*"),
        notes.select("document_id", "a.id", *[F.col(f"a.{c}") for c in _NOTE], tags.alias("tags")),
        judged.where("reason IS NOT NULL").select("value", "reason"),
    )

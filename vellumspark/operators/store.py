"""Keyed writes, promotion between stores, integrity, lookups and section navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumspark.functions.text import utc_time
from vellumspark.session import materialise

#: Conflict policy of promotion: key columns, and the columns that an existing row takes over (None: all).
PROMOTION = {
    "documents": (["id"], None),
    "sections": (["id"], None),
    "blocks": (["id"], None),
    "processing_jobs": (["id"], None),
    "job_chunks": (["id"], None),
    "tags": (["id"], ["name"]),
    "block_tags": (["block_id", "tag_id"], []),
    "annotations": (["id"], ["note_body", "highlighted_text", "anchor_metadata", "updated_at"]),
    "layout_height_cache": (["block_id"], ["estimated_height"]),
}
#: References of each table: (column, table it names); they cascade.
REFERENCES = {
    "documents": [("corpus_id", "corpora")],
    "sections": [("document_id", "documents"), ("parent_id", "sections")],
    "blocks": [("section_id", "sections"), ("document_id", "documents")],
    "annotations": [("document_id", "documents"), ("block_id", "blocks")],
    "block_tags": [("block_id", "blocks"), ("tag_id", "tags")],
    "processing_jobs": [("document_id", "documents")],
    "job_chunks": [("job_id", "processing_jobs")],
    "layout_height_cache": [("block_id", "blocks")],
    "vector_cache": [("block_id", "blocks")],
}
#: Unique columns and columns that must have a value, beside keys.
UNIQUE = {"tags": ["name"]}
REQUIRED = {
    "corpora": ["name"], "documents": ["title", "source_type", "sha256_hash", "storage_path"], "sections": ["title", "depth_level", "sort_order"], "blocks": ["block_type", "content", "sort_order"],
    "annotations": ["annotation_type"], "tags": ["name", "source"], "processing_jobs": ["status"], "job_chunks": ["raw_text", "chunk_order", "status"], "layout_height_cache": ["estimated_height"], "vector_cache": ["vector"],
}


#: Values of columns that a new row doesn't name.
DEFAULTS: dict[str, dict[str, str | int]] = {
    "documents": {"source_type": "pdf"}, "sections": {"depth_level": 1}, "blocks": {"block_type": "paragraph", "token_count": 0}, "annotations": {"annotation_type": "highlight"},
    "processing_jobs": {"status": "pending", "progress_percentage": 0}, "job_chunks": {"status": "pending"}, "conversation_history": {"token_count": 0}, "pass1_chunks": {"chunk_token_count": 0},
}


def with_defaults(name: str, rows: DataFrame) -> DataFrame:
    """New rows of a table with the defaults of columns that they lack; a null that is written stays one."""
    return rows.withColumns({c: F.lit(v) for c, v in DEFAULTS.get(name, {}).items() if c not in rows.columns})


def replace(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Replace-by-key: old rows of the new keys go, new rows come."""
    return base.join(new.select(*keys).distinct().hint("merge"), keys, "left_anti").unionByName(new)


def delete(base: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't listed."""
    return base.join(keys_df.select(*keys).distinct().hint("merge"), keys, "left_anti")


def insert_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows and those new rows whose key is not there yet; existing rows stay."""
    return base.unionByName(new.dropDuplicates(keys).join(base.select(*keys).hint("merge"), keys, "left_anti").select(*base.columns))


def upsert(base: DataFrame, new: DataFrame, keys: list[str], taken: list[str] | None = None) -> DataFrame:
    """Keyed upsert: new keys are inserted, existing rows take over the listed columns (None: all)."""
    taken = [c for c in base.columns if c not in keys] if taken is None else taken
    old = base.select(*keys, F.lit(True).alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in base.columns if c not in keys])
    fresh = new.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in base.columns if c not in keys])
    both = old.join(fresh.hint("merge"), keys, "full_outer")

    def pick(c: str) -> Column:
        use_new = F.col("_new").isNotNull() & (F.lit(c in taken) | F.col("_old").isNull())
        return F.when(use_new, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c)

    return both.select(*[F.col(c) if c in keys else pick(c) for c in base.columns])


def promote(scratch: dict[str, DataFrame], content: dict[str, DataFrame], document_ids: DataFrame) -> dict[str, DataFrame]:
    """Upserts the listed documents' rows from scratch to content, table by table.

    Tags, tag links and heights are copied unscoped; chunks follow their jobs.
    """
    ids = document_ids.select(F.col("document_id"))
    found = {}
    for name, (keys, taken) in PROMOTION.items():
        if name not in scratch:
            continue
        rows = scratch[name]
        if name == "documents":
            rows = rows.join(ids.withColumnRenamed("document_id", "id").hint("merge"), "id", "left_semi")
        elif name == "job_chunks":
            jobs = scratch["processing_jobs"].join(ids.hint("merge"), "document_id", "left_semi").select(F.col("id").alias("job_id"))
            rows = rows.join(jobs.hint("merge"), "job_id", "left_semi")
        elif "document_id" in rows.columns:
            rows = rows.join(ids.hint("merge"), "document_id", "left_semi")
        found[name] = upsert(content[name], rows, keys, taken)
    return found


def publish(tables: dict[str, DataFrame], path: str, version: int) -> None:
    """Writes tables as one version of a store; its marker is made last, so readers see all of them or none."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/v={version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    fs, marker = _file(spark, f"{path}/published/{version}")
    fs.create(marker, True).close()


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the newest published version of a store; none before the first."""
    fs, markers = _file(spark, f"{path}/published")
    if not fs.exists(markers):
        return {}
    newest = max(int(s.getPath().getName()) for s in fs.listStatus(markers))
    _, folder = _file(spark, f"{path}/v={newest}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return {name: spark.read.parquet(f"{path}/v={newest}/{name}") for name in names}


def _file(spark: SparkSession, path: str) -> tuple:
    """(file system, path) as Hadoop objects."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def wipe(scratch: dict[str, DataFrame], document_ids: DataFrame) -> dict[str, DataFrame]:
    """Scratch tables without the listed documents' rows; documents and corpora stay."""
    out = {}
    for name, rows in scratch.items():
        scoped = "document_id" in rows.columns and name not in ("documents", "corpora")
        out[name] = delete(rows, document_ids, ["document_id"]) if scoped else rows
    return out


def cascade_delete(tables: dict[str, DataFrame], root: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Tables after deleting ids of ``root`` and everything that refers to them, at any depth.

    The doomed ids of a table grow by its references until none is new; a table that names itself
    (sections by their parents) takes one more round for each level.
    """
    gone = {root: materialise(ids.select(F.col("id")).distinct(), "gone")}
    fresh = dict(gone)
    while fresh:
        found = {}
        for child, references in REFERENCES.items():
            if child not in tables or "id" not in tables[child].columns:
                continue
            for column, parent in references:
                if parent in fresh and column in tables[child].columns:
                    hit = tables[child].join(fresh[parent].withColumnRenamed("id", column).hint("merge"), column, "left_semi").select("id")
                    found[child] = found[child].unionByName(hit) if child in found else hit
        fresh = {}
        for child, hit in found.items():
            hit = hit.distinct()
            new = materialise(hit.join(gone[child].hint("merge"), "id", "left_anti") if child in gone else hit, "gone")
            if not new.isEmpty():
                fresh[child] = new
                gone[child] = gone[child].unionByName(new) if child in gone else new
    out = dict(tables)
    for name in tables:
        if name in gone:
            out[name] = delete(tables[name], gone[name], ["id"])
        elif "id" not in tables[name].columns:
            for column, parent in REFERENCES.get(name, []):
                if parent in gone and column in tables[name].columns:
                    out[name] = delete(out[name], gone[parent].withColumnRenamed("id", column), [column])
    return out


def integrity_report(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """[table, rule, key, count]: duplicate keys and unique columns, missing values and dangling references.

    Rules on columns that a table doesn't hold are left out.
    """
    found = []

    def broken(name: str, rule: str, rows: DataFrame) -> None:
        found.append(rows.select(F.lit(name).alias("table"), F.lit(rule).alias("rule"), F.col("key"), F.col("count")))

    for name, rows in tables.items():
        unique = [keys[name]] if name in keys else []
        for columns in [*unique, *[[c] for c in UNIQUE.get(name, []) if c in rows.columns]]:
            key = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
            broken(name, "unique", rows.groupBy(key.alias("key")).agg(F.count("*").alias("count")).where("count > 1"))
        needed = [*keys.get(name, []), *[c for c in REQUIRED.get(name, []) if c in rows.columns]]
        if needed:
            # one row: the number of missing values in each column
            counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in needed])
            listed = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("count")) for c in needed])).alias("x")).select("x.*")
            broken(name, "not null", listed.where("count > 0"))
        for column, parent in REFERENCES.get(name, []):
            if parent in tables and column in rows.columns:
                parents = tables[parent].select(F.col("id").alias(column)).distinct()
                loose = rows.where(F.col(column).isNotNull()).select(column).join(parents.hint("merge"), column, "left_anti")
                broken(name, "reference", loose.groupBy(F.col(column).cast("string").alias("key")).agg(F.count("*").alias("count")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def latest_wins(base: DataFrame, incoming: DataFrame, key: str = "id", stamp: str = "updated_at") -> DataFrame:
    """One row per key, the latest; a tie keeps the base's row."""
    both = base.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.col(stamp).desc_nulls_last(), "_side")
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_side")


def delta_since(df: DataFrame, stamp: str, since: str) -> DataFrame:
    """Rows changed after a time; times that are texts are read in both their forms, and rows without a readable one are left out."""
    if dict(df.dtypes)[stamp] == "string":
        return df.where(utc_time(F.col(stamp)) > utc_time(F.lit(since)))
    return df.where(F.col(stamp) > F.lit(since).cast(df.schema[stamp].dataType))


def heights_or_estimate(estimates: DataFrame, cache: DataFrame) -> DataFrame:
    """[block_id, height, cached]: the cached height if there is one, else the estimate."""
    joined = estimates.join(cache.select("block_id", F.col("estimated_height").alias("_c")).hint("merge"), "block_id", "left")
    return joined.select("block_id", F.coalesce("_c", "estimated_height").alias("height"), F.col("_c").isNotNull().alias("cached"))


def sections_or_whole(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sections in order; documents with blocks but no section get one synthetic whole-document section."""
    bare = blocks.select("document_id").distinct().join(sections.select("document_id").distinct().hint("merge"), "document_id", "left_anti")
    whole = bare.select(F.concat(F.lit("__unlinked__"), F.col("document_id")).alias("id"), "document_id", F.lit("Full Document").alias("title"), F.lit(0).alias("sort_order"))
    return sections.select("id", "document_id", "title", "sort_order").unionByName(whole)


def section_nav(sections: DataFrame) -> DataFrame:
    """[document_id, id, prev_id, next_id, label, window_ids] by section order."""
    order = Window.partitionBy("document_id").orderBy("sort_order", "id")
    prev_title, next_title = F.lag("title").over(order), F.lead("title").over(order)
    label = F.concat_ws("   ", F.concat(F.lit("< "), prev_title), F.concat(F.lit("["), F.col("title"), F.lit("]")), F.concat(next_title, F.lit(" >")))
    return sections.select(
        "document_id", "id", F.lag("id").over(order).alias("prev_id"), F.lead("id").over(order).alias("next_id"), label.alias("label"),
        F.array_join(F.collect_list("id").over(order.rowsBetween(-1, 1)), ",").alias("window_ids"),
    )


def dedup_by_hash(df: DataFrame, content: str, key: str) -> DataFrame:
    """[sha256_hash, id, copies]: one row per distinct content, its smallest id and number of copies."""
    return df.groupBy(F.sha2(content, 256).alias("sha256_hash")).agg(F.min(key).alias("id"), F.count("*").alias("copies"))


def filter_library(df: DataFrame, query: str) -> DataFrame:
    """Documents whose title or author contains the query, whatever the case; an empty query keeps all."""
    q = query.strip().lower()
    return df.where(F.lower("title").contains(q) | F.lower(F.coalesce("author", F.lit(""))).contains(q)) if q else df


def chunk_like(chunks: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """First ``limit`` chunks whose text matches ``%query%`` (wildcards work), by id."""
    return chunks.where(F.col("text").ilike(f"%{query}%")).orderBy("id").limit(limit)


def chunk_by_id(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """[id, text, error]: chunks by id; missing ones carry an error."""
    joined = wanted.select("id").join(chunks.select("id", "text").hint("merge"), "id", "left")
    return joined.select("id", "text", F.when(F.col("text").isNull(), "Chunk not found").alias("error"))


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON; binary columns as ``<blob N bytes>``."""
    shown = [F.concat(F.lit("<blob "), F.octet_length(c).cast("string"), F.lit(" bytes>")).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("json"))


def put_vectors(store: DataFrame, new: DataFrame) -> DataFrame:
    """Vector store after a write: the last vector of a block wins."""
    return replace(store, new, ["id"])


def get_vectors(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors of the listed blocks."""
    return store.join(ids.select("id").distinct().hint("merge"), "id", "left_semi")


def resolve(annotations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Annotations whose note text is overwritten by [id, note_body] decisions."""
    new = decisions.select("id", F.col("note_body").alias("_n"))
    joined = annotations.join(new.hint("merge"), "id", "left")
    return joined.withColumn("note_body", F.coalesce("_n", "note_body")).select(*annotations.columns)

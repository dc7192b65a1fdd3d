"""Block trees as rows: every value of a JSON tree with its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.session import materialise

#: Keys whose values make up index text, in the order in which a node writes them.
INDEXED = ("text", "code", "alt", "caption")


def _is_container(v: Column) -> Column:
    return F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)<")


def tree_rows(blocks: DataFrame, depth: int = 8) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of blocks [block_id, content].

    ``rows`` [block_id, path, key, value, kind, place] holds every value below the root down to
    ``depth`` levels: ``key`` is a field's name or an entry's number, ``value`` is null for
    objects, arrays and JSON null, ``place`` sorts the values of a block. Fields of an object have no order of
    their own: indexed keys come first, then the others by name. ``rejects`` [block_id, path]
    names the values at that depth that hold further ones. Content that is no JSON has no rows.

    Every level is one lateral join with the values of the level before; nothing is shuffled. The objects and
    arrays of a level are written once, so no level is opened again for those below it, and the last one
    that holds any ends the walk.
    """
    tvf = blocks.sparkSession.tvf
    root = blocks.select("block_id", F.lit("$").alias("path"), F.array().cast("array<string>").alias("place"), F.try_parse_json("content").alias("v")).where("v IS NOT NULL")
    root = materialise(root, "tree-roots")

    def below(level: DataFrame) -> DataFrame:
        opened = level.lateralJoin(tvf.variant_explode(F.col("v").outer()))
        listed = F.col("key").isNull()
        first = F.array_position(F.array(*[F.lit(k) for k in INDEXED]), F.col("key"))
        rank = F.when(listed, F.lpad(F.col("pos").cast("string"), 10, "0")).when(first > 0, first.cast("string")).otherwise(F.concat(F.lit("9"), F.col("key")))
        return opened.select(
            "block_id", F.when(listed, F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", F.lit("."), "key")).alias("path"),
            F.concat("place", F.array(rank)).alias("place"), F.coalesce("key", F.col("pos").cast("string")).alias("key"), F.col("value").alias("v"),
        )

    level, found = root, []
    for _ in range(depth):
        level = below(level)
        text = F.when(~_is_container(F.col("v")), F.try_variant_get("v", "$", "string"))
        found.append(level.select("block_id", "path", "key", text.alias("value"), F.schema_of_variant("v").alias("kind"), "place"))
        level = materialise(level.drop("key").where(_is_container(F.col("v"))), "tree-level")
        if level.isEmpty():
            break
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows, level.lateralJoin(tvf.variant_explode(F.col("v").outer())).select("block_id", "path").distinct()


def index_text(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """[block_id, text]: a block's indexed values joined by spaces; null if its tree has none; content that is no JSON as it is."""
    flag = F.when(F.col("kind") == "BOOLEAN", F.when(F.col("value") == "true", "1").otherwise("0")).otherwise(F.col("value"))
    kept = rows.where(F.col("key").isin(*INDEXED) & F.col("value").isNotNull()).select("block_id", "place", flag.alias("value"))
    joined = kept.groupBy("block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), " ").alias("joined"))
    whole = blocks.select("block_id", F.when(F.try_parse_json("content").isNull(), F.col("content")).alias("plain"))
    return whole.join(joined.hint("merge"), "block_id", "left").select("block_id", F.coalesce("plain", "joined").alias("text"))

"""The tree of files, classes and symbols that a reader opens, its order, its search, and the way from a symbol to its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.text import path_of_id

#: Types that stand below a file.
SYMBOLS = ("function", "class", "interface", "struct", "module")


def _bare(label: Column) -> Column:
    return F.regexp_replace(label, r"\(\)$", "")


def tree(nodes: DataFrame) -> DataFrame:
    """``(file_id, parent_id, id, kind, name, place)``: files, below them classes and then symbols that no class of the file
    contains, below a class the symbols whose name its code contains. ``place`` is the place among siblings by name, then id,
    from 0, classes first; files, of which there may be any number, have none: their order is ``name, id``.

    A symbol that several classes contain stands below each. Rows of ``nodes`` that repeat count once; symbols whose file has
    no node have no row, and null labels count as empty.
    """
    rows = nodes.select("id", F.coalesce("label", F.lit("")).alias("name"), "type", "code").dropDuplicates(["id"])
    files = rows.filter("type = 'file'").select(F.col("id").alias("file_id"), "name", F.regexp_replace("id", "^file:", "").alias("path"))
    parts = F.split("id", ":")
    inner = F.array_join(F.slice(parts, 2, F.size(parts) - 2), ":")
    below = rows.filter(F.col("type").isin(*SYMBOLS) & (F.size(parts) >= 3)).withColumn("path", inner).join(files.select("file_id", "path"), "path")
    classes = below.filter("type = 'class'").select("file_id", F.col("id").alias("class_id"), "name", F.col("code").alias("body"))
    others = below.filter("type <> 'class'").select("file_id", "id", "name")
    nested = others.join(classes.select("file_id", "class_id", "body"), "file_id").filter(F.contains("body", _bare(F.col("name"))))
    nested = nested.select("file_id", F.col("class_id").alias("parent_id"), "id", F.lit("symbol").alias("kind"), "name")
    alone = others.join(nested.select("file_id", "id"), ["file_id", "id"], "left_anti").select("file_id", F.col("file_id").alias("parent_id"), "id", F.lit("symbol").alias("kind"), "name")
    heads = classes.select("file_id", F.col("file_id").alias("parent_id"), F.col("class_id").alias("id"), F.lit("class").alias("kind"), "name")
    order = Window.partitionBy("parent_id").orderBy("kind", "name", "id")
    placed = heads.unionByName(alone).unionByName(nested).withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))
    top = files.select("file_id", F.lit(None).cast("string").alias("parent_id"), F.col("file_id").alias("id"), F.lit("file").alias("kind"), "name", F.lit(None).cast("bigint").alias("place"))
    return top.unionByName(placed)


def search_tree(rows: DataFrame, query: str) -> DataFrame:
    """The rows of a tree whose name, or the name of one below them, contains ``query`` in any case; all for an empty one."""
    if not query:
        return rows
    hits = rows.filter(F.contains(F.lower("name"), F.lit(query.lower())))
    kept = (
        hits.select("id", "parent_id")
        .unionByName(hits.filter("kind <> 'file'").select(F.col("parent_id").alias("id"), F.col("file_id").alias("parent_id")))
        .unionByName(hits.filter("kind <> 'file'").select(F.col("file_id").alias("id"), F.lit(None).cast("string").alias("parent_id")))
    )
    kept = kept.select("id", F.when(F.col("id") == F.col("parent_id"), None).otherwise(F.col("parent_id")).alias("parent_id")).distinct()
    return rows.join(kept, (rows["id"] == kept["id"]) & rows["parent_id"].eqNullSafe(kept["parent_id"]), "left_semi")


def parent_files(nodes: DataFrame) -> DataFrame:
    """``(id, file_id)``: the file that one gets to from a symbol, the first in scan order whose path is the symbol's or ends
    with it at a directory. Each file's path meets the symbols by its endings, an equality join.
    """
    path = path_of_id(F.col("id"))
    files = nodes.filter("type = 'file'").groupBy("id").agg(F.min("ordinal").alias("ordinal"))
    parts = F.split(F.regexp_replace("id", "^file:", ""), "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    ends = files.select(F.col("id").alias("file_id"), "ordinal", F.explode(endings).alias("path"))
    own = nodes.filter(F.col("type").isin("function", "class", "interface", "struct")).select("id", path.alias("path")).distinct()
    return own.join(ends, "path").groupBy("id").agg(F.min_by("file_id", F.struct("ordinal", "file_id")).alias("file_id"))

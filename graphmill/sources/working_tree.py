"""Working-tree status in porcelain form, and its overlay on nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.text import path_of_id, unified_path


def parse_porcelain(lines: DataFrame) -> DataFrame:
    """``(ordinal, path, status)`` of lines ``XY PATH``: ``D``, ``A`` or ``M``; a renamed file counts under its new name.

    ``lines`` has ``ordinal`` and ``line``, unstripped. Empty and null lines have no row; of a path that repeats, the last counts.
    """
    code, path = F.trim(F.substring("line", 1, 2)), F.trim(F.expr("substring(line, 4)"))
    new = F.coalesce(F.try_element_at(F.split(path, " -> "), F.lit(2)), path)
    status = F.when(code.contains("D"), "D").when(code.contains("A") | (code == "??"), "A").otherwise("M")
    rows = lines.filter(F.length("line") > 3).select("ordinal", unified_path(new).alias("path"), status.alias("status")).filter("path <> ''")
    return rows.groupBy("path").agg(F.min("ordinal").alias("ordinal"), F.max_by("status", "ordinal").alias("status"))


def node_status(nodes: DataFrame, status: DataFrame, strict: bool = True) -> DataFrame:
    """``(node_id, status)`` of the nodes whose file has changed.

    By default whole paths are compared, by an equality join that holds at any size. Without ``strict`` a status path matches
    if it is within the node's path, of file nodes within the basename, and the first match in status order counts: a theta
    join, whose status side, a working tree's changes, is meant to be small.
    """
    path: Column = F.when(F.col("type") == "file", F.col("path") if strict else F.col("label")).otherwise(path_of_id(F.col("id")))
    own = nodes.select(F.col("id").alias("node_id"), unified_path(path).alias("_file")).filter("_file <> ''").distinct()
    on = F.col("_file") == F.col("path") if strict else F.contains(F.col("_file"), F.col("path"))
    found = own.join(status, on)
    return found.groupBy("node_id").agg(F.min_by("status", "ordinal").alias("status"))


def last_turns(messages: DataFrame, group: str, turn: str, keep: int = 12) -> DataFrame:
    """The last ``keep`` messages of each conversation, as a window that stops early."""
    order = Window.partitionBy(group).orderBy(F.col(turn).desc())
    return messages.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= keep).drop("_rank")

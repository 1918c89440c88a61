"""Relational operators over the graph: adjacency, degrees, entry points, selections and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.text import extension, export_language
from graphmill.operators.heavy_keys import skew_safe_stats
from graphmill.operators.layout import running_sum


def distinct_calls(edges: DataFrame) -> DataFrame:
    """``(caller, callee)`` once each; unresolved calls (null) are none. The adjacency in both directions, row by row."""
    return edges.filter("caller IS NOT NULL AND callee IS NOT NULL").select("caller", "callee").distinct()


def callees_of(calls: DataFrame) -> DataFrame:
    """``(node, n, neighbours)``: distinct callees of each caller, sorted. A caller's body bounds their number."""
    return calls.groupBy(F.col("caller").alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("callee")), "|").alias("neighbours")
    )


def callers_of(calls: DataFrame, least: int = 20) -> DataFrame:
    """``(node, n, neighbours)``: the number of distinct callers and the first ``least`` of them, sorted.

    A shared symbol may be called by a third of the corpus, so its callers are kept as rows (``distinct_calls``); the list
    is a bounded sample of the smallest ids. Each of 64 parts of a hot callee's callers keeps its ``least`` before they meet.
    """
    part = F.pmod(F.xxhash64("caller"), F.lit(64))
    local = F.row_number().over(Window.partitionBy("callee", "_part").orderBy("caller"))
    ranked = calls.withColumn("_part", part).withColumn("_rank", local).filter(F.col("_rank") <= least)
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("callee").orderBy("caller"))).filter(F.col("_rank") <= least)
    counts = calls.groupBy(F.col("callee").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    lists = ranked.groupBy(F.col("callee").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("caller")), "|").alias("neighbours"))
    return counts.join(lists, "node")


def in_degrees(edges: DataFrame) -> DataFrame:
    """``(callee, n_callers)``, hot callees spread over salts."""
    stats = skew_safe_stats(edges.withColumn("_now", F.lit(0)), "callee", "caller", "_now")
    return stats.select("callee", F.col("n_members").alias("n_callers"))


def entry_points(calls: DataFrame) -> DataFrame:
    """``(node)``: callers that nobody calls."""
    called = calls.select(F.col("callee").alias("node")).distinct()
    return calls.select(F.col("caller").alias("node")).distinct().join(called, "node", "left_anti")


def induced(calls: DataFrame, ids: DataFrame) -> DataFrame:
    """The calls between nodes of ``ids`` (column ``id``)."""
    return calls.join(ids.select(F.col("id").alias("caller")), "caller", "left_semi").join(ids.select(F.col("id").alias("callee")), "callee", "left_semi").select("caller", "callee")


def related(calls: DataFrame, node: str) -> DataFrame:
    """``(other, direction)`` of a node's calls: its callees ``out``, its callers ``in``."""
    own = calls.filter((F.col("caller") == node) | (F.col("callee") == node))
    return own.select(
        F.when(F.col("caller") == node, F.col("callee")).otherwise(F.col("caller")).alias("other"),
        F.when(F.col("caller") == node, "out").otherwise("in").alias("direction"),
    ).distinct()


def top_callers(calls: DataFrame, nodes: DataFrame, k: int = 3) -> DataFrame:
    """``(callee, caller, rank)``: callers of the same file first, then those with most callees, then by id; at most ``k``.

    Each partition keeps ``k`` candidates a callee before the final ranking, so that a hot callee's callers never meet.
    """
    degree = calls.groupBy("caller").agg(F.count(F.lit(1)).alias("degree"))
    path = F.try_element_at(F.split("callee", ":"), F.lit(2))
    same = F.coalesce(F.contains(F.col("caller"), path), F.lit(False)).cast("int")
    ranked = calls.join(degree, "caller").withColumn("same", same).withColumn("_part", F.pmod(F.xxhash64("caller"), F.lit(64)))
    order = [F.col("same").desc(), F.col("degree").desc(), F.col("caller")]
    local = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("callee", "_part").orderBy(*order))).filter(F.col("_r") <= k)
    final = local.withColumn("rank", F.row_number().over(Window.partitionBy("callee").orderBy(*order)).cast("bigint"))
    return final.filter(F.col("rank") <= k).join(nodes.select(F.col("id").alias("callee")).distinct(), "callee", "left_semi").select("callee", "caller", "rank")


def primary_language(nodes: DataFrame, group: str) -> DataFrame:
    """``(group, language)``: the extension that most file nodes have; of several, the one that comes first."""
    files = nodes.filter(F.col("type") == "file").select(group, F.regexp_replace(extension(F.col("label")), r"^\.", "").alias("ext"), "ordinal")
    counts = files.groupBy(group, "ext").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"))
    return counts.groupBy(group).agg(export_language(F.max_by("ext", F.struct("n", -F.col("first")))).alias("language"))


def map_filter(nodes: DataFrame, search: str = "", hidden_exts: tuple[str, ...] = (), hidden_types: tuple[str, ...] = ()) -> DataFrame:
    """Nodes whose label contains ``search``, in any case, and whose extension and type are not hidden."""
    path = F.coalesce(F.col("path"), F.try_element_at(F.split("id", ":"), F.lit(2)), F.lit(""))
    kept = nodes.filter(F.contains(F.lower("label"), F.lit(search.lower())))
    kept = kept.filter(~F.col("type").isin(*hidden_types)) if hidden_types else kept
    return kept.filter(~extension(path).isin(*hidden_exts)) if hidden_exts else kept


def drill_down(nodes: DataFrame, links: DataFrame, selected: str | None = None) -> DataFrame:
    """Without a selection the root and the files; with one the node and the targets of its links."""
    if selected is None:
        return nodes.filter(F.col("type").isin("root", "file"))
    targets = links.filter(F.col("source") == selected).select(F.col("target").alias("id"))
    return nodes.filter(F.col("id") == selected).unionByName(nodes.filter(F.col("id") != selected).join(targets, "id", "left_semi"))


def siblings(links: DataFrame) -> DataFrame:
    """``(parent, child, index, siblings)`` of structural links: the place within the parent from 0, and how many there are.

    The root may be the parent of all files: places are running sums over ranges, so that no parent is a single task's."""
    structural = links.filter(~F.coalesce(F.col("type") == "call", F.lit(False))).select("source", "target", "ordinal")
    parents = structural.groupBy(F.col("target").alias("child")).agg(F.min_by("source", "ordinal").alias("parent"), F.min("ordinal").alias("ordinal"))
    placed = running_sum(parents.select("parent", F.struct("ordinal", "child").alias("_key"), F.lit(1).cast("bigint").alias("_one")), "parent", "_key", "_one")
    sizes = parents.groupBy("parent").agg(F.count(F.lit(1)).alias("siblings"))
    return placed.join(sizes, "parent").select("parent", F.col("_key.child").alias("child"), F.col("before").alias("index"), "siblings")


def class_members(nodes: DataFrame) -> DataFrame:
    """``(path, class_id, function_id)``: functions whose name a class of the same file contains; standalone ones have no class."""
    path = F.try_element_at(F.split("id", ":"), F.lit(2))
    named = nodes.filter(F.col("type").isin("function", "class")).select("id", "type", "code", path.alias("path"), F.regexp_replace("label", r"\(\)$", "").alias("name")).distinct()
    classes = named.filter("type = 'class'").select("path", F.col("id").alias("class_id"), F.col("code").alias("body"))
    functions = named.filter("type = 'function'").select("path", F.col("id").alias("function_id"), "name")
    inside = functions.join(classes, "path").filter(F.contains(F.col("body"), F.col("name"))).select("path", "class_id", "function_id")
    alone = functions.select("path", "function_id").distinct().join(inside.select("path", "function_id"), ["path", "function_id"], "left_anti")
    return inside.unionByName(alone.withColumn("class_id", F.lit(None).cast("string")))


def recent(visits: DataFrame, key: str, time: str, keep: int = 8) -> DataFrame:
    """The ``keep`` keys visited last, each once: ``(key, time)``."""
    return visits.groupBy(key).agg(F.max(time).alias(time)).orderBy(F.desc(time), key).limit(keep)

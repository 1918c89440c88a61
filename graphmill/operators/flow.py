"""Bounded call flows from one node, backwards to callers or forwards to callees.

A flow emits at most ``max_nodes`` nodes, and no more ids than these come to the driver; their edges stay a table. Levels are
expanded in an order that does not depend on partitions: by the parent's rank, the neighbour's id, the component member's
id. Ids that no row of the nodes has are ends of edges only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.text import path_of_id
from graphmill.operators.scc import cycle_edges

#: Callees from which a forward flow stops at a node, and members from which it stays within a component.
FAN_OUT, LARGE_COMPONENT = 10, 5


@dataclass
class Flow:
    """A flow's nodes ``(id, depth, rank)`` and further columns, its edges ``(caller, callee, is_cycle)``, and whether it was cut."""

    nodes: DataFrame
    edges: DataFrame
    truncated: bool
    source: str


class UnknownNode(KeyError):
    """The node that a flow starts from is not in the graph."""


def _facts(taken: DataFrame, calls: DataFrame, multi: DataFrame) -> dict[str, tuple[int, str | None]]:
    """Of each node of a level: how many callees it has, and its component if that is large."""
    large = multi.filter(F.col("scc_size") > LARGE_COMPONENT).select(F.col("node_id").alias("here"), "scc_id")
    counts = calls.join(F.broadcast(taken), calls["caller"] == taken["here"]).groupBy("here").agg(F.count_distinct("callee").alias("n"))
    rows = taken.join(counts, "here", "left").join(large, "here", "left").select("here", F.coalesce("n", F.lit(0)).alias("n"), "scc_id").collect()
    return {r["here"]: (r["n"], r["scc_id"]) for r in rows}


def _flow(nodes: DataFrame, calls: DataFrame, scc: DataFrame, start: str, max_depth: int, max_nodes: int, forward: bool) -> Flow:
    spark = nodes.sparkSession
    here, there = ("caller", "callee") if forward else ("callee", "caller")
    ids = nodes.select("id").distinct()
    if not ids.filter(F.col("id") == start).limit(1).count():
        raise UnknownNode(start)
    multi = scc.filter("scc_size > 1")
    members = multi.select("scc_id", F.col("node_id").alias("next"))
    emitted: list[tuple[str, int, int, int, bool]] = []
    recorded: list[tuple[str]] = []
    level, depth = [start][: max(max_nodes, 0)], 0
    cut = max_nodes <= 0
    while level:
        facts: dict[str, tuple[int, str | None]] = {}
        if forward:
            facts = _facts(spark.createDataFrame([(n,) for n in level], "here string"), calls, multi)
        expanding: list[tuple[str, int, str | None]] = []
        for node in level:
            total, large = facts.get(node, (0, None))
            stopped = node != start and total > FAN_OUT
            emitted.append((node, depth, len(emitted), total, stopped))
            if not stopped:
                expanding.append((node, len(expanding), large))
        recorded += [(n,) for n, _, _ in expanding]
        quota = max_nodes - len(emitted)
        cut = quota <= 0
        if cut or not expanding:
            break
        ranks = spark.createDataFrame(expanding, "here string, rank int, stay string")
        near = calls.select(F.col(here).alias("here"), F.col(there).alias("there")).join(F.broadcast(ranks), "here")
        # From a large component only its own members follow.
        near = near.join(multi.select(F.col("node_id").alias("there"), "scc_id"), "there", "left").filter("stay IS NULL OR stay <=> scc_id")
        first = F.min(F.struct("rank", "there")).alias("at")
        # A neighbour on a cycle brings its whole component, whatever the depth: the first call into it decides the place.
        whole = near.filter("scc_id IS NOT NULL").groupBy("scc_id").agg(first).join(members, "scc_id").select("next", "at")
        reach = whole
        if depth < max_depth:
            reach = whole.unionByName(near.filter("scc_id IS NULL").groupBy(F.col("there").alias("next")).agg(first))
        visited = spark.createDataFrame([(e[0],) for e in emitted], "next string")
        fresh = reach.join(ids.withColumnRenamed("id", "next"), "next", "left_semi").join(F.broadcast(visited), "next", "left_anti")
        following = [r["next"] for r in fresh.orderBy("at.rank", "at.there", "next").limit(quota + 1).collect()]
        cut = len(following) > quota
        level, depth = following[:quota], depth + 1
    cut = cut or len(emitted) >= max_nodes
    found = spark.createDataFrame(emitted, "id string, depth int, rank int, total_callees bigint, truncated_calls boolean")
    ends = spark.createDataFrame(recorded, f"{here} string")
    edges = calls.join(F.broadcast(ends), here, "left_semi").select("caller", "callee").distinct()
    return Flow(_described(found, nodes, calls, multi, forward), cycle_edges(edges, scc), cut, start)


def _described(found: DataFrame, nodes: DataFrame, calls: DataFrame, multi: DataFrame, forward: bool) -> DataFrame:
    last = nodes.join(F.broadcast(found.select("id")), "id", "left_semi").groupBy("id").agg(F.max_by(F.struct("label", "type", "code"), "ordinal").alias("_n"))
    info = multi.groupBy("scc_id").agg(F.count(F.lit(1)).alias("members"), F.min("node_id").alias("least"))
    called = calls.join(F.broadcast(found.select(F.col("id").alias("callee"))), "callee", "left_semi").select(F.col("callee").alias("id"), F.lit(True).alias("_called")).distinct()
    rows = (
        found.join(last, "id")
        .join(multi.select(F.col("node_id").alias("id"), "scc_id"), "id", "left")
        .join(info, "scc_id", "left")
        .join(called, "id", "left")
    )
    return rows.select(
        "id", F.replace("_n.label", F.lit("()"), F.lit("")).alias("name"), "_n.type", path_of_id(F.col("id")).alias("file_id"), "_n.code", "depth", "rank",
        (F.lit(not forward) & F.col("_called").isNull()).alias("is_entry_point"), F.col("scc_id").isNotNull().alias("in_cycle"), "scc_id",
        F.coalesce("members", F.lit(0)).alias("scc_members"), F.coalesce(F.col("id") == F.col("least"), F.lit(False)).alias("is_representative"),
        "total_callees", "truncated_calls",
    )


def reverse_flow(nodes: DataFrame, calls: DataFrame, scc: DataFrame, start: str, max_depth: int = 2, max_nodes: int = 25) -> Flow:
    """Who calls ``start``, and who calls those. A caller on a cycle brings all its component's members at the next depth,
    whatever ``max_depth``. All calls into an expanded node are edges, also from callers that are not emitted. ``truncated``
    also says so where exactly ``max_nodes`` nodes were found. Raises UnknownNode."""
    return _flow(nodes, calls, scc, start, max_depth, max_nodes, forward=False)


def forward_flow(nodes: DataFrame, calls: DataFrame, scc: DataFrame, start: str, max_depth: int = 2, max_nodes: int = 25) -> Flow:
    """Whom ``start`` calls, and whom those call. A callee on a cycle brings all its component's members at the next depth,
    whatever ``max_depth``. A node other than ``start`` with more than FAN_OUT callees is emitted without its edges; from a
    component of more than LARGE_COMPONENT members only its own members follow. Raises UnknownNode."""
    return _flow(nodes, calls, scc, start, max_depth, max_nodes, forward=True)


def metadata(flow: Flow) -> DataFrame:
    """One row: source, numbers of nodes and edges, depth used, whether it was cut and whether it has cycles."""
    n = flow.nodes.agg(F.count(F.lit(1)).alias("node_count"), F.max("depth").alias("depth_used"))
    e = flow.edges.agg(F.count(F.lit(1)).alias("edge_count"), F.coalesce(F.bool_or("is_cycle"), F.lit(False)).alias("has_cycles"))
    one = [x.withColumn("_one", F.lit(1)) for x in (n, e)]
    return one[0].join(one[1], "_one").select(
        F.lit(flow.source).alias("source_id"), path_of_id(F.lit(flow.source)).alias("source_file"), "node_count", "edge_count", "depth_used",
        F.lit(flow.truncated).alias("truncated"), "has_cycles",
    )


def locate(flow_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, node_id)``: each flow node in the full graph, by id, else by label among functions and classes."""
    by_id = nodes.select(F.col("id").alias("_i")).distinct()
    named = nodes.filter(F.col("type").isin("function", "class"))
    by_label = named.groupBy(F.replace("label", F.lit("()"), F.lit("")).alias("_label")).agg(F.min_by("id", F.struct("ordinal", "id")).alias("_l"))
    joined = flow_nodes.join(by_id, flow_nodes["id"] == by_id["_i"], "left").join(by_label, flow_nodes["name"] == by_label["_label"], "left")
    return joined.select("id", F.coalesce("_i", "_l").alias("node_id"))


def ranked_siblings(flow_nodes: DataFrame) -> DataFrame:
    """``(id, depth, index, at_depth)``: the place of a node within its depth."""
    order = Window.partitionBy("depth").orderBy("rank")
    return flow_nodes.select("id", "depth", (F.row_number().over(order) - 1).alias("index"), F.count(F.lit(1)).over(Window.partitionBy("depth")).alias("at_depth"))

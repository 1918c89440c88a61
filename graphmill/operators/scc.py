"""Strongly connected components by trimming and label propagation, and what follows from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.session import checkpointed

#: Links up to which the trimmed graph is solved in one task by a linear algorithm; larger graphs are solved by joins.
LOCAL_LINKS = 200_000
#: Rounds of trimming before the propagation, and the share of links that a round must remove for another one: trimming
#: only saves work, so it need not reach the end.
TRIM_ROUNDS, TRIM_SHARE = 12, 0.1


def components_of(links: list[tuple[str, str]]) -> list[list[str]]:
    """The components of more than one node: what a node reaches against the links, among those that a search along the
    links left later, are its component (two searches, each with an explicit stack)."""
    after: dict[str, list[str]] = {}
    before: dict[str, list[str]] = {}
    for a, b in links:
        after.setdefault(a, []).append(b)
        before.setdefault(b, []).append(a)
    left: list[str] = []
    seen: set[str] = set()
    for start in after:
        todo = [(start, False)]
        while todo:
            node, done = todo.pop()
            if done:
                left.append(node)
            elif node not in seen:
                seen.add(node)
                todo.append((node, True))
                todo.extend((other, False) for other in after.get(node, ()) if other not in seen)
    out = []
    for start in reversed(left):
        if start not in seen:
            continue
        seen.discard(start)
        component = [start]
        for node in component:  # grows while it is read
            fresh = [other for other in before.get(node, ()) if other in seen]
            seen.difference_update(fresh)
            component.extend(dict.fromkeys(fresh))
        if len(component) > 1:
            out.append(component)
    return out


def _local(group: pd.DataFrame) -> pd.DataFrame:
    found = components_of(list(zip(group["caller"].tolist(), group["callee"].tolist(), strict=True)))
    rows = [(node, least) for c in found for least in [min(c)] for node in c]
    return pd.DataFrame(rows, columns=["node", "root"])


def _trimmed(links: DataFrame) -> DataFrame:
    """Links without those of nodes that no link enters or none leaves: such nodes are on no cycle."""
    size = links.count()
    for _ in range(TRIM_ROUNDS):
        kept = links.join(links.select(F.col("callee").alias("caller")).distinct(), "caller", "left_semi")
        kept = checkpointed(kept.join(kept.select(F.col("caller").alias("callee")).distinct(), "callee", "left_semi").select("caller", "callee"))
        if (now := kept.count()) > (1 - TRIM_SHARE) * size:
            break
        links, size = kept, now
    return kept


def _propagated(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels(node, root)`` where each node takes the least label that links bring it, until nothing changes."""
    while True:
        heard = links.join(labels, links["caller"] == labels["node"]).groupBy("callee").agg(F.min("root").alias("heard"))
        stepped = checkpointed(
            labels.join(heard, labels["node"] == heard["callee"], "left").select("node", F.least("root", F.coalesce("heard", "root")).alias("next"), "root")
        )
        if not stepped.filter("next < root").limit(1).count():
            return stepped.select("node", "root")
        labels = stepped.select("node", F.col("next").alias("root"))


def _by_joins(links: DataFrame) -> DataFrame:
    """Forward: each node's label is the least node that reaches it. Backward within a label: what reaches its root is the
    root's component. Those nodes leave, and the rest goes on."""
    found: DataFrame | None = None
    while links.limit(1).count():
        nodes = links.select(F.col("caller").alias("node")).union(links.select("callee")).distinct()
        labels = _propagated(links, checkpointed(nodes.withColumn("root", F.col("node"))))
        sided = links.join(labels.select(F.col("node").alias("caller"), F.col("root").alias("r1")), "caller").join(
            labels.select(F.col("node").alias("callee"), F.col("root").alias("r2")), "callee"
        )
        inside = checkpointed(sided.filter("r1 = r2").select("caller", "callee", F.col("r1").alias("root")))
        reached = checkpointed(inside.select(F.col("root").alias("node"), "root").distinct())
        while True:
            new = (
                inside.join(reached.select(F.col("node").alias("callee"), "root"), ["callee", "root"])
                .select(F.col("caller").alias("node"), "root")
                .distinct()
                .join(reached, ["node", "root"], "left_anti")
            )
            grown = checkpointed(reached.unionByName(new))
            if grown.count() == reached.count():
                break
            reached = grown
        found = reached if found is None else found.unionByName(reached)
        gone = reached.select("node")
        rest = inside.join(gone.withColumnRenamed("node", "caller"), "caller", "left_anti").join(gone.withColumnRenamed("node", "callee"), "callee", "left_anti")
        links = _trimmed(checkpointed(rest.select("caller", "callee")))
    if found is None:
        return links.select(F.col("caller").alias("node"), F.col("callee").alias("root"))
    big = found.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter("n > 1")
    return found.join(big, "root").select("node", F.col("least").alias("root"))


def components(calls: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """``(node_id, scc_id, scc_size)`` of every node with a call: its component's least id and size, 1 for those on no cycle.

    Calls of a node to itself make no cycle; null ends are no calls; repeated calls count once. No calls give no rows.
    """
    clean = checkpointed(calls.filter("caller IS NOT NULL AND callee IS NOT NULL").select("caller", "callee").distinct())
    core = _trimmed(clean.filter("caller <> callee"))
    if core.count() <= local_links:
        cyclic = core.groupBy(F.lit(0).alias("one")).applyInPandas(_local, "node string, root string")
    else:
        cyclic = _by_joins(core)
    cyclic = checkpointed(cyclic)
    sizes = cyclic.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    nodes = clean.select(F.col("caller").alias("node")).union(clean.select("callee")).distinct()
    joined = nodes.join(cyclic.join(sizes, "root"), "node", "left")
    return joined.select(F.col("node").alias("node_id"), F.coalesce("root", "node").alias("scc_id"), F.coalesce("size", F.lit(1)).alias("scc_size"))


def cycle_edges(calls: DataFrame, scc: DataFrame) -> DataFrame:
    """``(caller, callee, is_cycle)``: both ends in one component of more than one node."""
    multi = scc.filter("scc_size > 1").select("node_id", "scc_id")
    a, b = multi.select(F.col("node_id").alias("caller"), F.col("scc_id").alias("s1")), multi.select(F.col("node_id").alias("callee"), F.col("scc_id").alias("s2"))
    joined = calls.join(a, "caller", "left").join(b, "callee", "left")
    return joined.select("caller", "callee", F.coalesce(F.col("s1") == F.col("s2"), F.lit(False)).alias("is_cycle"))

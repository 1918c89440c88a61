"""What a question about a node needs: code, callers, callees, documentation, status and the trimmed conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.extract import docstring_udf, signature_udf
from graphmill.functions.text import extension, path_of_id, short_path
from graphmill.operators.graph import top_callers
from graphmill.operators.layout import running_sum

#: Callers and callees with code, lines of a caller, callers and callees in a conversation, characters of their code.
CALLERS, CALLEES, CALLER_LINES = 5, 5, 50
CHAT_CALLERS, CHAT_CALLEES, SNIPPET = 3, 1, 1500
#: Names of neighbours, and messages of a conversation, that are kept.
NAMES, HISTORY = 15, 12


def latest(nodes: DataFrame) -> DataFrame:
    """One row an id, the last: ``(id, label, type, path, code)``."""
    return nodes.groupBy("id").agg(F.max_by(F.struct("label", "type", "path", "code"), "ordinal").alias("_n")).select("id", "_n.*")


def node_source(nodes: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """``(id, source)``: a node's own code, else its file's text, if the file lies under ``root``.

    ``files`` has ``rel_path`` and ``content``. A path that leads out of the root has no source.
    """
    path = F.coalesce(F.col("path"), path_of_id(F.col("id")))
    inside = ~F.coalesce(path, F.lit("")).rlike(r"(^|/)\.\.(/|$)|^/") | F.lit(bool(root)) & F.startswith(path, F.lit(root.rstrip("/") + "/"))
    own = latest(nodes).select("id", "code", F.when(inside, path).alias("rel_path"))
    return own.join(files.select("rel_path", "content"), "rel_path", "left").select("id", F.coalesce(F.when(F.length("code") > 0, F.col("code")), "content").alias("source"))


def _ranked(calls: DataFrame, by: str, other: str, k: int) -> DataFrame:
    part = F.pmod(F.xxhash64(other), F.lit(64))
    local = F.row_number().over(Window.partitionBy(by, "_p").orderBy(other))
    kept = calls.withColumn("_p", part).withColumn("_r", local).filter(F.col("_r") <= k)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(other))).filter(F.col("rank") <= k).select(by, other, "rank")


def caller_snippets(calls: DataFrame, nodes: DataFrame, k: int = CALLERS, lines: int = CALLER_LINES) -> DataFrame:
    """``(callee, caller, rank, label, code)``: the first ``k`` callers, by id, with code of at most ``lines`` lines."""
    bodies = latest(nodes).filter(F.length("code") > 0).select(F.col("id").alias("caller"), "label", "code")
    parts = F.split("code", "\n")
    cut = F.when(F.size(parts) > lines, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("\n... (truncated)"))).otherwise(F.col("code"))
    return _ranked(calls, "callee", "caller", k).join(bodies, "caller").select("callee", "caller", F.col("rank").cast("bigint").alias("rank"), "label", cut.alias("code"))


def callee_signatures(calls: DataFrame, nodes: DataFrame, k: int = CALLEES) -> DataFrame:
    """``(caller, callee, rank, label, signature)``: the first ``k`` callees, by id, with the head of their code."""
    bodies = latest(nodes).filter(F.length("code") > 0).select(F.col("id").alias("callee"), "label", "code")
    return _ranked(calls, "caller", "callee", k).join(bodies, "callee").select("caller", "callee", F.col("rank").cast("bigint").alias("rank"), "label", signature_udf(F.col("code")).alias("signature"))


def context(nodes: DataFrame, calls: DataFrame, docs: DataFrame | None = None, status: DataFrame | None = None) -> DataFrame:
    """``(node_id, code, docstring, short_path, callers, callees, docs, git_status)`` of every symbol.

    Callers and callees are arrays of structs, null where there are none. ``docs`` has ``rel_path`` and ``docs``; ``status``
    has ``node_id`` and ``status``.
    """
    own = latest(nodes).filter(~F.col("type").isin("root", "file"))
    callers = caller_snippets(calls, nodes).groupBy(F.col("callee").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "caller", "label", "code"))).alias("callers"))
    callees = callee_signatures(calls, nodes).groupBy(F.col("caller").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "callee", "label", "signature"))).alias("callees"))
    path = path_of_id(F.col("id"))
    rows = own.join(callers, "id", "left").join(callees, "id", "left").withColumn("_path", path)
    none = F.lit(None).cast("string")
    rows = rows.join(docs.select(F.col("rel_path").alias("_path"), "docs"), "_path", "left") if docs is not None else rows.withColumn("docs", none)
    rows = rows.join(status.select(F.col("node_id").alias("id"), "status"), "id", "left") if status is not None else rows.withColumn("status", none)
    return rows.select(
        F.col("id").alias("node_id"), "code", docstring_udf(F.col("code"), extension(F.coalesce("_path", F.lit("")))).alias("docstring"),
        short_path(F.col("_path")).alias("short_path"), "callers", "callees", "docs", F.col("status").alias("git_status"),
    )


def chat_context(calls: DataFrame, nodes: DataFrame, callers: int = CHAT_CALLERS, callees: int = CHAT_CALLEES, snippet: int = SNIPPET) -> DataFrame:
    """``(node_id, role, other, rank, label, path, body)``: what a conversation about a node is given of its neighbours.

    Its first ``callers`` callers (of the same file first, then by number of callees, then by id) and its first ``callees``
    callees by id, each with at most ``snippet`` characters of code. Neighbours are chosen first: one without code or without
    a node has no row, and no other one takes its place.
    """
    above = top_callers(calls, nodes, callers).select(F.col("callee").alias("node_id"), F.lit("caller").alias("role"), F.col("caller").alias("other"), "rank")
    own = nodes.select(F.col("id").alias("caller")).distinct()
    below = _ranked(calls, "caller", "callee", callees).join(own, "caller", "left_semi")
    below = below.select(F.col("caller").alias("node_id"), F.lit("callee").alias("role"), F.col("callee").alias("other"), F.col("rank").cast("bigint").alias("rank"))
    bodies = latest(nodes).filter(F.length("code") > 0).select(F.col("id").alias("other"), "label", "path", F.substring("code", 1, snippet).alias("body"))
    return above.unionByName(below).join(bodies, "other").select("node_id", "role", "other", "rank", "label", "path", "body")


def neighbour_names(calls: DataFrame, nodes: DataFrame, k: int = NAMES) -> DataFrame:
    """``(node, names)``: labels of the first ``k`` callees by id, joined by commas."""
    labels = latest(nodes).select(F.col("id").alias("callee"), "label")
    first = _ranked(calls, "caller", "callee", k).join(labels, "callee")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda s: s["label"]), ", ")
    return first.groupBy(F.col("caller").alias("node")).agg(names.alias("names"))


def running_budget(texts: DataFrame, group: str, key: str, text: str, budget: int) -> DataFrame:
    """``texts`` with ``taken``: characters of each text that fit in its group's budget, in the order of ``key``, which is
    unique; rows without room, and those of null groups, are left out.

    Only keys and lengths are put in order, a group in as many ranges as the whole: a group of any size is no single task's.
    """
    sizes = texts.filter(F.col(group).isNotNull()).select(group, key, F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("_size"))
    placed = running_sum(sizes, group, key, "_size").filter(F.col("before") < budget)
    taken = placed.select(key, F.least(F.col("_size"), F.lit(budget) - F.col("before")).alias("taken"))
    return texts.join(taken, key)

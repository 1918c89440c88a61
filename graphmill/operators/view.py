"""Cycle-aware views of a flow: hide, show, keep or collapse cycles, limit depth, prune and remap edges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.functions.text import rolling_hash

UNLIMITED = 1 << 30


@dataclass
class ViewState:
    """What a view shows. ``remap_first`` moves edges to summaries before edges without visible ends are pruned."""

    cycle_mode: str = "show"
    max_scc_size: int = 5
    max_depth: int = 10
    expanded: tuple[str, ...] = ()
    remap_first: bool = False


# The named views.
PRESETS = {
    "readable": ViewState("collapse", 5, 10),
    "full": ViewState("show", UNLIMITED, UNLIMITED),
    "cyclesOnly": ViewState("only", UNLIMITED, UNLIMITED),
    "minimal": ViewState("hide", 3, 5),
}


@dataclass
class View:
    """Visible nodes, visible edges, and one row of what is hidden."""

    nodes: DataFrame
    edges: DataFrame
    hidden: DataFrame
    state: ViewState = field(default_factory=ViewState)


def summaries(nodes: DataFrame, state: ViewState) -> DataFrame:
    """A summary node for each component that is too large and not expanded, with its members' ids."""
    grouped = nodes.filter("in_cycle AND scc_id IS NOT NULL").groupBy("scc_id").agg(
        F.count(F.lit(1)).alias("member_count"),
        F.array_sort(F.collect_list(F.struct("rank", "id", "name", "file_id"))).alias("_m"),
        F.min("depth").alias("depth"),
    )
    large = grouped.filter((F.col("member_count") > state.max_scc_size) & ~F.col("scc_id").isin(list(state.expanded)))
    ids = F.col("_m.id")
    return large.select(
        F.concat(F.lit("scc-summary:"), rolling_hash(F.array_join(F.array_sort(ids), "|"))).alias("id"), F.lit("scc-summary").alias("type"),
        F.format_string("♻ Cycle (%d)", "member_count").alias("name"), "member_count", F.slice("_m.name", 1, 5).alias("member_names"),
        ids.alias("member_ids"), "scc_id", "depth", F.lit(True).alias("expandable"), F.coalesce(F.element_at("_m.file_id", 1), F.lit("")).alias("file_id"),
    )


def apply_view(nodes: DataFrame, edges: DataFrame, state: ViewState) -> View:
    """The view of a flow: cycle mode, then depth, then edges without visible ends, then edges of summaries.

    ``nodes`` are a flow's; ``edges`` have ``caller`` and ``callee``. A depth limit of 0 or less is none. In mode ``show`` a component
    whose representative is not among the nodes is not shown at all, and not counted as hidden.
    """
    plain = nodes.select("id", "name", "type", "depth", "file_id", "scc_id", "in_cycle", "is_representative")
    summary = None
    cyclic = F.col("in_cycle") & F.col("scc_id").isNotNull()
    if state.cycle_mode == "hide":
        kept, gone = plain.filter("NOT in_cycle"), plain.filter("in_cycle")
        hidden = gone.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("scc_id").alias("sccs"))
    elif state.cycle_mode == "only":
        kept, gone = plain.filter("in_cycle"), plain.filter("NOT in_cycle")
        hidden = gone.agg(F.count(F.lit(1)).alias("nodes"), F.lit(0).cast("bigint").alias("sccs"))
    elif state.cycle_mode == "collapse":
        summary = summaries(nodes, state)
        members = summary.select(F.col("id").alias("summary_id"), F.explode("member_ids").alias("id"))
        kept = plain.join(members, "id", "left_anti").unionByName(
            summary.select("id", "name", "type", "depth", "file_id", "scc_id", F.lit(False).alias("in_cycle"), F.lit(False).alias("is_representative"))
        )
        hidden = summary.agg(F.coalesce(F.sum("member_count"), F.lit(0)).alias("nodes"), F.count(F.lit(1)).alias("sccs"))
    else:
        kept = plain.filter(~cyclic | F.col("scc_id").isin(list(state.expanded)) | F.col("is_representative"))
        hidden = plain.agg(F.lit(0).cast("bigint").alias("nodes"), F.lit(0).cast("bigint").alias("sccs"))
    shown = kept.filter(F.col("depth") <= state.max_depth) if state.max_depth > 0 else kept
    deep = kept.filter(F.col("depth") > state.max_depth).agg(F.count(F.lit(1)).alias("deep")) if state.max_depth > 0 else None
    if deep is not None:
        hidden = hidden.withColumn("_k", F.lit(1)).join(deep.withColumn("_k", F.lit(1)), "_k").select((F.col("nodes") + F.col("deep")).alias("nodes"), "sccs")
    hidden = hidden.withColumn("utility", F.lit(0).cast("bigint"))
    pairs = edges.select("caller", "callee")
    if summary is not None and state.remap_first:
        pairs = _remapped(pairs, members)
    ends = shown.select("id")
    pairs = pairs.join(ends.withColumnRenamed("id", "caller"), "caller", "left_semi").join(ends.withColumnRenamed("id", "callee"), "callee", "left_semi")
    if summary is not None and not state.remap_first:
        pairs = _remapped(pairs, members)
    return View(shown, pairs.select("caller", "callee"), hidden, state)


def _remapped(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with members replaced by their summaries, once each and without loops."""
    a = members.select(F.col("id").alias("caller"), F.col("summary_id").alias("_a"))
    b = members.select(F.col("id").alias("callee"), F.col("summary_id").alias("_b"))
    moved = pairs.join(a, "caller", "left").join(b, "callee", "left")
    return moved.select(F.coalesce("_a", "caller").alias("caller"), F.coalesce("_b", "callee").alias("callee")).distinct().filter("caller <> callee")


def toggled(expanded: tuple[str, ...], scc_id: str) -> tuple[str, ...]:
    """The expanded components after one is clicked."""
    return tuple(x for x in expanded if x != scc_id) if scc_id in expanded else (*expanded, scc_id)


def needs_confirmation(member_count: int) -> bool:
    """Whether expanding a component should be confirmed."""
    return member_count > 10

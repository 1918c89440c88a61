"""A graph of one repository, with one method for each question that can be asked of it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.operators import context as ctx
from graphmill.operators import export, flow, graph, scc, symbols, tree, view
from graphmill.session import checkpointed
from graphmill.sources import repository, working_tree
from graphmill.streaming import scan


@dataclass
class Graph:
    """Nodes in scan order, and the files that they come from (a null table for graphs that have none)."""

    spark: SparkSession
    nodes: DataFrame
    files: DataFrame | None = None
    root: str = ""

    @classmethod
    def build(cls, spark: SparkSession, root: str) -> Graph:
        """Scans a directory: manifest, parallel reading and parsing."""
        files = repository.read_sources(repository.manifest(spark, root))
        name = root.rstrip("/").rsplit("/", 1)[-1]
        return cls(spark, checkpointed(symbols.build_nodes(files, name)), files, root)

    @cached_property
    def references(self) -> DataFrame:
        return checkpointed(symbols.resolve_edges(self.nodes))

    @cached_property
    def calls(self) -> DataFrame:
        return self.references.select(F.col("source").alias("caller"), F.col("target").alias("callee"))

    @cached_property
    def links(self) -> DataFrame:
        calls = symbols.capped_links(self.references).select("ordinal", "source", "target", F.lit("call").alias("type"))
        return symbols.containment(self.nodes).unionByName(calls)

    @cached_property
    def scc(self) -> DataFrame:
        return checkpointed(scc.components(self.calls))

    def reverse_flow(self, node: str, max_depth: int = 2, max_nodes: int = 25) -> flow.Flow:
        return flow.reverse_flow(self.nodes, self.calls, self.scc, node, max_depth, max_nodes)

    def forward_flow(self, node: str, max_depth: int = 2, max_nodes: int = 25) -> flow.Flow:
        return flow.forward_flow(self.nodes, self.calls, self.scc, node, max_depth, max_nodes)

    def view(self, found: flow.Flow, state: view.ViewState | None = None) -> view.View:
        return view.apply_view(found.nodes, found.edges, state or view.ViewState())

    def source(self, node: str) -> str | None:
        own = self.nodes.filter(F.col("id") == node)
        files = self.files if self.files is not None else self.spark.createDataFrame([], "rel_path string, content string")
        row = ctx.node_source(own, files).first()
        return row["source"] if row else None

    def context(self, docs: DataFrame | None = None, status: DataFrame | None = None) -> DataFrame:
        """``docs`` has ``rel_path`` and ``docs``, as from ``documentation``."""
        return ctx.context(self.nodes, self.calls, docs, status)

    def documentation(self, texts: DataFrame) -> DataFrame:
        """The documentation near each file; ``texts`` has ``rel_path`` and ``content`` of the documentation files."""
        paths = self.nodes.filter("type = 'file'").select(F.col("path").alias("rel_path")).distinct()
        return repository.near_documentation(paths, texts)

    def chat(self) -> DataFrame:
        """Callers and callees with code for a conversation about each node."""
        return ctx.chat_context(self.calls, self.nodes)

    def tree(self, query: str = "") -> DataFrame:
        return tree.search_tree(tree.tree(self.nodes), query)

    def parents(self) -> DataFrame:
        return tree.parent_files(self.nodes)

    def neighbours(self) -> DataFrame:
        return ctx.neighbour_names(self.calls, self.nodes)

    def locate(self, found: flow.Flow) -> DataFrame:
        return flow.locate(found.nodes, self.nodes)

    def trimmed(self, messages: DataFrame, group: str, turn: str) -> DataFrame:
        """The end of each conversation."""
        return working_tree.last_turns(messages, group, turn, ctx.HISTORY)

    def clear_cache(self, folder: str) -> int:
        """Removes the saved scans below ``folder``; how many there were."""
        return export.Cache(self.spark, folder).clear()

    def export(self, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        language = graph.primary_language(self.nodes.withColumn("_g", F.lit(0)), "_g").first()
        meta = export.export_meta(self.spark, self.root, language["language"] if language else None)
        return export.export_nodes(self.nodes, ids), export.export_edges(self.links, ids), meta

    def status(self, porcelain: DataFrame, strict: bool = True) -> DataFrame:
        return working_tree.node_status(self.nodes, working_tree.parse_porcelain(porcelain), strict)

    def messages(self, cached: bool = False) -> DataFrame:
        return scan.messages(self.nodes, self.links, self.nodes.filter("type = 'file'").count(), cached)

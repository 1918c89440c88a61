"""A scan as ordered messages, and as a stream over a landing directory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.functions.extract import parse_sources
from graphmill.operators.layout import global_index

#: Nodes and links of a message, of a fresh scan and of a cached one; milliseconds between a client's redraws.
NODE_BATCH, LINK_CHUNK, CACHED_NODES, CACHED_LINKS = 12, 200, 80, 500


def numbered(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """``rows`` with ``chunk`` from 0, each of ``size`` rows in order; the numbering needs no single task."""
    return global_index(rows, *order).withColumn("chunk", F.floor(F.col("index") / size)).drop("index")


def messages(nodes: DataFrame, links: DataFrame, total_files: int, cached: bool = False) -> DataFrame:
    """``(stage, chunk, kind, payload)`` of a scan: root, meta, node batches, status, link chunks, done. Payloads are JSON
    without code. Ordered by ``stage`` and ``chunk``."""
    spark = nodes.sparkSession
    node_size, link_size = (CACHED_NODES, CACHED_LINKS) if cached else (NODE_BATCH, LINK_CHUNK)
    lean = nodes.filter("type <> 'root'").select("ordinal", "id", "label", "type", "path")
    batches = numbered(lean, node_size, "ordinal", "id").groupBy("chunk").agg(F.to_json(F.array_sort(F.collect_list(F.struct("ordinal", "id", "label", "type", "path")))).alias("payload"))
    chunks = numbered(links.select("ordinal", "source", "target", "type"), link_size, "ordinal", "source", "target").groupBy("chunk").agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("ordinal", "source", "target", "type")))).alias("payload")
    )
    root = nodes.filter("type = 'root'").select(F.lit(0).cast("bigint").alias("chunk"), F.to_json(F.array(F.struct("id", "label", "type"))).alias("payload"))
    parts = [(0, "nodes", root), (2, "nodes", batches), (4, "links", chunks)]
    out = spark.createDataFrame(
        [(1, 0, "meta", f'{{"totalFiles":{total_files}}}'), (3, 0, "status", '{"phase":"links"}'), (5, 0, "done", "{}")], "stage int, chunk bigint, kind string, payload string"
    )
    for stage, kind, df in parts:
        out = out.unionByName(df.select(F.lit(stage).alias("stage"), "chunk", F.lit(kind).alias("kind"), "payload"))
    return out


def events(rows: DataFrame) -> Iterator[str]:
    """The messages as server-sent events, in order; the driver holds one partition at a time."""
    for row in rows.orderBy("stage", "chunk").toLocalIterator():
        yield f'data: {{"type":"{row["kind"]}","data":{row["payload"]}}}\n\n'


def progress(files: DataFrame) -> DataFrame:
    """``(rel_path, done, total)``: files in order with the running count."""
    indexed = global_index(files.select("rel_path", "ordinal"), "ordinal")
    total = files.agg(F.count(F.lit(1)).alias("total")).withColumn("_one", F.lit(1))
    return indexed.withColumn("_one", F.lit(1)).join(total, "_one").select("rel_path", (F.col("index") + 1).alias("done"), "total")


def first_seen(nodes: DataFrame, order: str = "ordinal") -> DataFrame:
    """Nodes once an id, the first in order; ids that come again in later batches are dropped."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(order))
    return nodes.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def stream_nodes(spark: SparkSession, landing: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of nodes from JSON files ``(ordinal, rel_path, content)`` that land in a folder. Parsing keeps no state."""
    landed = spark.readStream.schema("ordinal bigint, rel_path string, content string").option("maxFilesPerTrigger", files_per_batch).json(landing)
    return parse_sources(landed)


def run_stream(nodes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream of nodes into ``sink(batch, number)``; references are resolved when all symbols are known, after it."""
    return nodes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

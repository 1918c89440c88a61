"""Exports in the canonical form, and snapshots of a built graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions.text import last_part, path_of_id

# The types of nodes that an export has, its schema's version and the cache's.
EXPORTED = ("function", "class", "interface", "struct")
SCHEMA_VERSION, CACHE_VERSION = "1.0", 2


def export_nodes(nodes: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(id, name, file)`` of the exported types, of ``ids`` (column ``id``) if given; rows that repeat stay."""
    own = nodes.filter(F.col("type").isin(*EXPORTED))
    own = own.join(ids.select("id").distinct(), "id", "left_semi") if ids is not None else own
    return own.select("id", F.replace(F.coalesce("label", F.lit("")), F.lit("()"), F.lit("")).alias("name"), F.coalesce(path_of_id(F.col("id")), F.lit("")).alias("file"))


def export_edges(links: DataFrame, ids: DataFrame | None = None, drop_dangling: DataFrame | None = None) -> DataFrame:
    """``(from, to, type)`` of the call links, between ``ids`` if given. Links to types that are not exported stay, unless
    ``drop_dangling`` has the exported nodes."""
    calls = links.filter("type = 'call'").select(F.col("source").alias("from"), F.col("target").alias("to"), "type")
    for side in (ids, drop_dangling):
        if side is not None:
            ends = side.select("id").distinct()
            calls = calls.join(ends.withColumnRenamed("id", "from"), "from", "left_semi").join(ends.withColumnRenamed("id", "to"), "to", "left_semi")
    return calls.select("from", "to", "type")


def export_meta(spark: SparkSession, repo_path: str | None, language: str | None) -> DataFrame:
    """One row ``(schema_version, repo, generated_at, language)``."""
    one = spark.range(1)
    name = F.when(F.lit(bool(repo_path)), last_part(F.lit(repo_path or ""))).otherwise("unknown")
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return one.select(F.lit(SCHEMA_VERSION).alias("schema_version"), name.alias("repo"), stamp.alias("generated_at"), F.lit(language or "unknown").alias("language"))


def flow_export(flow_nodes: DataFrame) -> DataFrame:
    """``(id, name, file)`` of a flow's nodes."""
    return flow_nodes.select("id", "name", F.coalesce("file_id", F.lit("")).alias("file"))


class Cache:
    """Snapshots of built graphs: a folder per repository, named by the hash of its path, with a manifest written last."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def place(self, repo_path: str) -> str:
        return f"{self.folder}/{self.spark.range(1).select(F.md5(F.lit(repo_path))).first()[0]}"

    def save(self, repo_path: str, fingerprint: str, tables: dict[str, DataFrame]) -> None:
        at = self.place(repo_path)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{at}/{name}")
        names = ",".join(sorted(tables))
        row = self.spark.createDataFrame([(CACHE_VERSION, repo_path, fingerprint, names)], "version int, repo_path string, fingerprint string, tables string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{at}/_manifest_")

    def load(self, repo_path: str, fingerprint: str) -> dict[str, DataFrame] | None:
        """The tables of a snapshot; None if it is missing, unreadable, of another version or of other files."""
        at = self.place(repo_path)
        try:
            row = self.spark.read.parquet(f"{at}/_manifest_").first()
            if row is None or row["version"] != CACHE_VERSION or row["fingerprint"] != fingerprint:
                return None
            return {name: self.spark.read.parquet(f"{at}/{name}") for name in row["tables"].split(",")}
        except Exception:  # a snapshot that can't be read is none
            return None

    def clear(self) -> int:
        """Deletes all snapshots through Hadoop's file system; returns how many there were."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return 0
        entries = fs.listStatus(path)
        for entry in entries:
            fs.delete(entry.getPath(), True)
        return len(entries)

"""Nodes, links, the symbol table, and the resolution of references between bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.functions.extract import parse_sources
from graphmill.functions.text import WORD, name_from_label

ROOT = "repo-root"
#: Types whose bodies are searched for references.
CALLERS = ("function", "class")
#: Call links that a client is sent.
LINK_CAP = 50_000


def build_nodes(files: DataFrame, root_label: str = "root") -> DataFrame:
    """``(ordinal, id, label, type, path, code, name)`` of the root, all files and their symbols, in scan order."""
    parsed = parse_sources(files)
    # Order is file, then place within: both fit one number, so no global sort is needed.
    ordinal = F.col("file_ordinal") * (1 << 20) + F.col("within") + 1
    spark: SparkSession = files.sparkSession
    root = spark.createDataFrame([(0, ROOT, root_label, "root")], "ordinal bigint, id string, label string, type string")
    return root.unionByName(parsed.select(ordinal.alias("ordinal"), "id", "label", "type", "path", "code", "name"), allowMissingColumns=True)


def containment(nodes: DataFrame) -> DataFrame:
    """``(ordinal, source, target, type)`` from the root to files and from files to their symbols; the type is null."""
    parts = F.split("id", ":")
    source = F.when(F.col("type") == "file", F.lit(ROOT)).otherwise(F.concat(F.lit("file:"), F.try_element_at(parts, F.lit(2))))
    return nodes.filter(F.col("type") != "root").select("ordinal", source.alias("source"), F.col("id").alias("target"), F.lit(None).cast("string").alias("type"))


def is_call(kind: Column) -> Column:
    """Whether a link is a call; structural links have a null type and are none."""
    return F.coalesce(kind == "call", F.lit(False))


def symbol_table(nodes: DataFrame) -> DataFrame:
    """``(name, node_id)``: of definitions with one name the last wins."""
    named = nodes.filter(~F.col("type").isin("file", "root")).select(name_from_label(F.col("label")).alias("name"), "id", "ordinal")
    return named.filter("name <> ''").groupBy("name").agg(F.max_by("id", F.struct("ordinal", "id")).alias("node_id"))


def scannable(nodes: DataFrame) -> DataFrame:
    """``(ordinal, id, own_name, code)`` of the bodies that can refer to others."""
    kept = nodes.filter(F.col("type").isin(*CALLERS) & (F.length("code") > 0))
    return kept.select("ordinal", "id", name_from_label(F.col("label")).alias("own_name"), "code")


def resolve_edges(nodes: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """``(source, target, ordinal, position)`` of each body's references to symbols other than its own name, once a body.

    A name that is one identifier is met by the body's tokens: an equality join of distinct tokens with the table, whose
    side Spark chooses by size. Other names (``A::b``, ``ok?``) join on their longest identifier and are then searched
    between identifier boundaries; names without any identifier join on their first mark. Positions order a body's references.
    """
    symbols = symbols if symbols is not None else symbol_table(nodes)
    # Repeated rows of a body are one body.
    bodies = scannable(nodes).groupBy("id", "own_name", F.xxhash64("code").alias("_hash")).agg(F.min("ordinal").alias("ordinal"), F.first("code").alias("code")).drop("_hash")
    word = F.col("name").rlike(f"^[{WORD}]+$")
    tokens = bodies.select("ordinal", "id", "own_name", F.posexplode(F.array_distinct(F.split("code", f"[^{WORD}]+"))).alias("position", "token")).filter("token <> ''")
    plain = tokens.join(symbols.filter(word), (F.col("token") == F.col("name")) & (F.col("name") != F.col("own_name")))
    plain = plain.select(F.col("id").alias("source"), F.col("node_id").alias("target"), "ordinal", F.col("position").cast("bigint").alias("position"))
    # A prefix such as a namespace stands in many bodies; the longest identifier of a name is likely to tell more.
    words = F.regexp_extract_all("name", F.lit(f"[{WORD}]+"), F.lit(0))
    lead = F.coalesce(F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"], F.lit(""))
    quoted = F.regexp_replace("name", r"([\\.\[\]{}()*+?^$|/-])", r"\\$1")
    boundary = F.concat(F.lit(f"(?s)(?<![{WORD}])"), quoted, F.lit(f"(?![{WORD}])"))
    marked = symbols.filter(~word).withColumn("lead", lead).withColumn("_pattern", boundary)
    hits = tokens.select("id", "token").join(marked.filter("lead <> ''"), F.col("token") == F.col("lead")).select("id", "name", "node_id", "_pattern")
    # Names without an identifier are met by their first mark, as it stands in the bodies' distinct characters.
    signs = bodies.select("id", F.explode(F.array_distinct(F.split(F.regexp_replace("code", f"[{WORD}\\s]+", ""), ""))).alias("sign")).filter("sign <> ''")
    bare = marked.filter("lead = ''").withColumn("sign", F.substring("name", 1, 1))
    found = hits.unionByName(signs.join(bare, "sign").select("id", "name", "node_id", "_pattern"))
    symbolic = (
        found.join(bodies, "id")
        .filter((F.col("name") != F.col("own_name")) & F.expr("rlike(code, _pattern)"))
        .select(F.col("id").alias("source"), F.col("node_id").alias("target"), "ordinal", F.expr("locate(name, code)").cast("bigint").alias("position"))
    )
    return plain.unionByName(symbolic).groupBy("source", "target").agg(F.min("ordinal").alias("ordinal"), F.min("position").alias("position"))


def capped_links(edges: DataFrame, cap: int = LINK_CAP, chunk: int = 200) -> DataFrame:
    """The first ``cap`` links in order with ``number`` (from 1) and ``chunk`` (from 0). Only the rows kept are numbered."""
    first = edges.orderBy("ordinal", "position", "source", "target").limit(cap)
    number = F.row_number().over(Window.orderBy("ordinal", "position", "source", "target")).cast("bigint")
    return first.withColumn("number", number).withColumn("chunk", F.floor((F.col("number") - 1) / chunk))

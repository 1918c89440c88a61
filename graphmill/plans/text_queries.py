"""Queries of scalar functions and extractors over given rows and whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.functions import text
from graphmill.functions.extract import parse_sources
from graphmill.operators.layout import global_index
from graphmill.session import table
from graphmill.streaming import scan

def intent_class(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.question_kind(F.col("text")).alias("kind"))


def looks_like_code(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.looks_like_code(F.col("text")).alias("code"))


def paste_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.paste_language(F.col("text"), F.lit(None).cast("string")).alias("language"))


def path_truncate(spark, sf_dir):
    paths = table(spark, sf_dir, "detail_requests").select("file_path").distinct()
    return paths.select("file_path", text.short_path(F.col("file_path")).alias("short"))


def math_cleanup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.without_math(F.col("text")).cast("binary")).alias("clean"))


def extension_histogram(spark, sf_dir):
    files = table(spark, sf_dir, "detail_requests").select(text.extension(F.col("file_path")).alias("ext"))
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("n"))


def parsed_symbols(spark, sf_dir):
    """Symbols of all file records: names, types and sizes of their code."""
    files = table(spark, sf_dir, "detail_requests").filter("lower(trim(node_type)) = 'file'").dropDuplicates(["request_id"])
    rows = parse_sources(files.select(F.col("request_id").alias("ordinal"), F.replace("file_path", F.lit("\\"), F.lit("/")).alias("rel_path"), F.col("code").alias("content")))
    return rows.filter("within > 0").select(F.col("file_ordinal").alias("request_id"), "within", "type", "name", F.length("code").cast("bigint").alias("size"))


def symbol_counts(spark, sf_dir):
    return parsed_symbols(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def node_batches(spark, sf_dir):
    nodes = table(spark, sf_dir, "nodes").select("id").distinct()
    return scan.numbered(nodes, scan.NODE_BATCH, "id").groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).select(F.col("chunk").cast("bigint").alias("chunk"), "n", "first")


def first_seen_nodes(spark, sf_dir):
    return scan.first_seen(table(spark, sf_dir, "nodes")).select("id", "ordinal")


def global_positions(spark, sf_dir):
    return global_index(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


QUERIES = {
    f.__name__: f
    for f in (
        intent_class, looks_like_code, paste_language, path_truncate, math_cleanup, extension_histogram, parsed_symbols, symbol_counts, node_batches,
        first_seen_nodes, global_positions,
    )
}


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_LINES = "list_filter(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) <> '')"
_ANY = "|".join(f"(?:{p})" for p in text.CODE_PATTERNS).replace("'", "''")
_GUESS = " ".join(f"WHEN regexp_matches(text, {_quoted('(?m)' + p)}) THEN {_quoted(lang)}" for lang, p in text.PASTE_PATTERNS)

SQL = {
    "intent_class": f"""
        SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), {_quoted(rf"\b(?:{text.BUG_WORDS.replace('race(?!\\w)', 'race')})\b")}) THEN 'bug'
        WHEN regexp_matches(lower(coalesce(text, '')), {_quoted(rf"\b(?:{text.DESIGN_WORDS})\b")}) THEN 'architecture' ELSE 'explain' END AS kind FROM documents""",
    "looks_like_code": f"""
        SELECT doc_id, coalesce(contains(text, chr(10)) AND len({_LINES}) >= 2 AND (len(list_filter({_LINES}, lambda l: regexp_matches(l, '^[ \\t]+[^ \\t\\n\\r\\f\\v]'))) >= 2
        OR regexp_matches(text, '(?m){_ANY}')), false) AS code FROM documents""",
    "paste_language": f"SELECT doc_id, CASE {_GUESS} ELSE '' END AS language FROM documents",
    "path_truncate": """
        SELECT DISTINCT file_path, CASE WHEN coalesce(file_path, '') = '' THEN '' WHEN len(string_split(replace(file_path, chr(92), '/'), '/')) <= 2 THEN replace(file_path, chr(92), '/')
        ELSE '.../' || list_aggregate(list_slice(string_split(replace(file_path, chr(92), '/'), '/'), -2, -1), 'string_agg', '/') END AS short FROM detail_requests""",
    "math_cleanup": """
        SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\\$\\$\\s*([\\s\\S]+?)\\s*\\$\\$', '```' || chr(10) || '\\1' || chr(10) || '```', 'g'), '\\$([^$\\n]+?)\\$', '`\\1`', 'g')) AS clean
        FROM documents""",
    "extension_histogram": """
        SELECT lower(regexp_extract(regexp_extract(replace(file_path, chr(92), '/'), '([^/]*)$', 1), '^[^.].*(\\.[^.]*)$', 1)) AS ext, count(*) AS n FROM detail_requests GROUP BY 1""",
    "node_batches": """
        WITH n AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 12 AS chunk FROM (SELECT DISTINCT id FROM nodes)) SELECT chunk, count(*) AS n, min(id) AS first FROM n GROUP BY chunk""",
    "first_seen_nodes": "SELECT id, min(ordinal) AS ordinal FROM nodes GROUP BY id",
    "global_positions": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders",
}

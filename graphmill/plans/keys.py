"""Queries of the heavy-key operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.operators.heavy_keys import heavy_keys, skew_safe_stats
from graphmill.session import table


def p4_found(spark, sf_dir):
    return heavy_keys(table(spark, sf_dir, "edges"), "callee", 0.01).select("callee")


def p4_callee_stats(spark, sf_dir):
    stats = skew_safe_stats(table(spark, sf_dir, "edges"), "callee", "caller", "seen_at")
    return stats.select(
        "callee",
        "n_rows",
        F.col("n_members").alias("n_callers"),
        F.col("first_time").alias("first_seen"),
        F.col("last_time").alias("last_seen"),
    )


QUERIES = {"p4_found": p4_found, "p4_callee_stats": p4_callee_stats}

SQL = {
    "p4_found": """
        SELECT callee FROM edges WHERE callee IS NOT NULL
        GROUP BY callee HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)""",
    "p4_callee_stats": """
        SELECT callee, count(*) AS n_rows, count(DISTINCT caller) AS n_callers,
               min(seen_at) AS first_seen, max(seen_at) AS last_seen
        FROM edges WHERE callee IS NOT NULL GROUP BY callee""",
}

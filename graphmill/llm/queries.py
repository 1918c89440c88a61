"""Queries over the test tables and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphmill.llm import credentials, functions, machine_files, mixing, spam_pages, split, syntax_check, tokenizer
from graphmill.llm.tables import LANGUAGES, requests, source_files, table


def p1_invalid(spark, sf_dir):
    return syntax_check.unparsable(source_files(spark, sf_dir))


def p1_found(spark, sf_dir):
    return p1_invalid(spark, sf_dir).select("request_id")


def p1_rates(spark, sf_dir):
    return syntax_check.unparsable_rates(source_files(spark, sf_dir))


def p2_found(spark, sf_dir):
    pieces = split.split_oversized(requests(spark, sf_dir), table(spark, sf_dir, "split_limits"))
    return pieces.filter("piece_no = 2").select("request_id").distinct()


def p2_pieces(spark, sf_dir):
    return split.split_oversized(requests(spark, sf_dir), table(spark, sf_dir, "split_limits"))


def p2_cover(spark, sf_dir):
    """Of each oversized record: where its pieces begin and end, and whether all limits and overlaps hold."""
    limits = table(spark, sf_dir, "split_limits").select(F.lower(F.trim("node_type")).alias("kind"), "max_chars", "overlap_chars")
    kinds = requests(spark, sf_dir).select("request_id", "kind").distinct().join(limits, "kind")
    before = F.lag("end").over(Window.partitionBy("request_id").orderBy("piece_no"))
    pieces = p2_pieces(spark, sf_dir).withColumn("_before", before).join(kinds, "request_id")
    return pieces.groupBy("request_id").agg(
        F.min("start").cast("bigint").alias("first"), F.max("end").cast("bigint").alias("last"),
        F.min(F.col("end") - F.col("start") <= F.col("max_chars")).alias("within"),
        F.min(F.coalesce(F.col("_before") - F.col("start") == F.col("overlap_chars"), F.lit(True))).alias("overlapping"),
    )


def p1_files(spark, sf_dir):
    """How many files of each repository and language the rates are of."""
    return p1_rates(spark, sf_dir).select("repo", "lang", "n_files")


def p3_labels(spark, sf_dir):
    return machine_files.classify_files(source_files(spark, sf_dir), table(spark, sf_dir, "library_files"))


def p3_found(spark, sf_dir):
    return p3_labels(spark, sf_dir).filter("label <> 'hand-written'").select("request_id")


def p5_findings(spark, sf_dir):
    return credentials.find_credentials(requests(spark, sf_dir))


def p5_found(spark, sf_dir):
    return p5_findings(spark, sf_dir).select("request_id", "line_no").distinct()


def p5_redacted(spark, sf_dir):
    return credentials.redact_credentials(requests(spark, sf_dir)).dropDuplicates(["request_id"])


def p6_pairs(spark, sf_dir):
    return functions.mark_templates(functions.documented_functions(source_files(spark, sf_dir)))


def p6_found(spark, sf_dir):
    return functions.documented_functions(source_files(spark, sf_dir)).select("request_id", "func_name", "line_no")


def p7_ids(spark, sf_dir):
    return tokenizer.encode(table(spark, sf_dir, "documents"))


def p7_joined(spark, sf_dir):
    """As p7_ids, with so few words in the broadcast that the others are joined, as in a large corpus."""
    return tokenizer.encode(table(spark, sf_dir, "documents"), frequent=2048)


def p8_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark, sf_dir):
    return mixing.shares(p8_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_scores(spark, sf_dir):
    return spam_pages.score_pages(table(spark, sf_dir, "documents"))


def p9_found(spark, sf_dir):
    return p9_scores(spark, sf_dir).filter("spam").select("doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_invalid": p1_invalid, "p1_rates": p1_rates, "p1_files": p1_files,
    "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_cover": p2_cover,
    "p3_found": p3_found, "p3_labels": p3_labels,
    "p5_found": p5_found, "p5_findings": p5_findings, "p5_redacted": p5_redacted,
    "p6_found": p6_found, "p6_pairs": p6_pairs,
    "p7_ids": p7_ids, "p7_joined": p7_joined, "p8_mix": p8_mix, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_scores": p9_scores,
}

_LANG = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LANGUAGES.items()) + "}[lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1))]"
SQL = {
    "p2_found": """
        SELECT DISTINCT request_id FROM detail_requests d
        JOIN split_limits s ON lower(trim(d.node_type)) = lower(trim(s.node_type))
        WHERE length(d.code) > s.max_chars""",
    "p2_cover": """
        SELECT DISTINCT request_id, 0 AS first, length(d.code) AS last, true AS within, true AS overlapping FROM detail_requests d
        JOIN split_limits s ON lower(trim(d.node_type)) = lower(trim(s.node_type)) WHERE length(d.code) > s.max_chars""",
    "p1_files": f"""
        WITH f AS (SELECT request_id, max(repo) AS repo, max({_LANG}) AS lang FROM detail_requests WHERE lower(trim(node_type)) = 'file' AND {_LANG} IS NOT NULL GROUP BY request_id)
        SELECT repo, lang, count(*) AS n_files FROM f GROUP BY repo, lang""",
}

"""The test tables as the operators of this subpackage want them: each request once, kinds and extensions in one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages and configuration formats by extension, in lower case.
LANGUAGES = {
    "py": "py", "js": "js", "jsx": "js", "ts": "ts", "tsx": "ts", "java": "java", "go": "go", "rs": "rs", "c": "c",
    "cpp": "cpp", "hpp": "cpp", "rb": "rb", "sh": "sh", "bash": "sh",
}
CONFIGURATION = ("yaml", "yml", "env", "json", "toml", "ini", "properties")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extension(path: Column) -> Column:
    """Extension of a path's last part in lower case, ``""`` if it has none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def kind(node_type: Column) -> Column:
    return F.lower(F.trim(node_type))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``detail_requests`` as delivered, with ``kind`` and ``ext``. A request delivered twice still has two rows, which
    hold the same content; the operators drop repeats of their small results instead of shuffling the code."""
    rows = table(spark, sf_dir, "detail_requests")
    return rows.select(
        "request_id", "repo", "file_path", "code", kind(F.col("node_type")).alias("kind"), extension(F.col("file_path")).alias("ext")
    )


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File records whose extension declares a language, with ``lang``."""
    lang = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    rows = requests(spark, sf_dir).filter((F.col("kind") == "file") & F.col("ext").isin(*LANGUAGES))
    return rows.withColumn("lang", F.try_element_at(lang, F.col("ext")))

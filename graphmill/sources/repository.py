"""Repositories on a file system as a table of files, and the documentation that lies near a file.

Spark's file sources leave out names that begin with a mark, so the driver lists the names and the workers read the texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.functions.extract import LANGUAGE_KEYS

# Directories and files that are never scanned.
IGNORED_DIRS = frozenset(
    """node_modules .git git-portable __pycache__ venv .venv env .env dist build .next target out .pytest_cache .mypy_cache .ruff_cache .turbo
    .cache coverage .gradle bin classes vendor .vs Debug Release x64 x86 ARM .idea .vscode gen __pypackages__ .eggs""".split()
)
IGNORED_FILES = frozenset("jquery.js jquery.min.js jquery.min.map bootstrap.js bootstrap.min.js bootstrap.min.map".split())
# Names of documentation files, in the order in which they are read.
DOC_NAMES = (
    "README.md", "readme.md", "README.rst", "readme.rst", "README", "ARCHITECTURE.md", "architecture.md", "documentation.md", "Documentation.md",
    "CONTRIBUTING.md", "contributing.md", "NOTES.md", "notes.md",
)
#: Characters of documentation that a file's context holds.
DOC_CHARS = 4000
#: The file that marks a directory as a Python environment.
ENVIRONMENT_MARK = "pyvenv.cfg"


def ignore_rules(lines: Iterable[str]) -> set[str]:
    """Bare directory names among ignore lines: no comments, negations, patterns or nested paths."""
    names = (line.strip().lstrip("/").rstrip("/") for line in lines if line.strip() and line.strip()[0] not in "#!")
    return {n for n in names if n and not set(n) & set("/*?")}


def walk(root: str) -> Iterator[tuple[str, str, int, float]]:
    """``(path, relative path, size, time of change)`` of the source files under ``root``, directories pruned on the way."""
    rules = os.path.join(root, ".gitignore")
    ignored = set(IGNORED_DIRS)
    if os.path.isfile(rules):
        with open(rules, encoding="utf-8", errors="ignore") as lines:
            ignored |= ignore_rules(lines)
    stack = [root]
    while stack:
        here = stack.pop()
        entries = sorted(os.scandir(here), key=lambda e: e.name)
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                continue
            if e.name not in IGNORED_FILES and os.path.splitext(e.name)[1].lower() in LANGUAGE_KEYS and e.is_file():
                info = e.stat()
                yield e.path, os.path.relpath(e.path, root).replace(os.sep, "/"), info.st_size, info.st_mtime
        stack += [
            e.path
            for e in reversed(entries)
            if e.is_dir(follow_symlinks=False) and e.name not in ignored and not e.name.startswith(".") and not e.name.endswith(".egg-info")
            and not os.path.isfile(os.path.join(e.path, ENVIRONMENT_MARK))
        ]


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """``(ordinal, path, rel_path, ext, size, mtime)`` of a repository's source files; no rows if there are none."""
    rows = [(k, p, r, os.path.splitext(r)[1].lower(), s, t) for k, (p, r, s, t) in enumerate(walk(root))]
    return spark.createDataFrame(rows, "ordinal bigint, path string, rel_path string, ext string, size bigint, mtime double")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for path in batch["path"]:
            try:
                with open(path, "rb") as f:
                    texts.append(f.read().decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n"))
            except OSError:
                texts.append(None)
        yield batch.assign(content=texts)


def read_sources(files: DataFrame) -> DataFrame:
    """A manifest with ``content``: UTF-8, bytes that are none dropped, line ends unified; null where reading fails."""
    columns = ", ".join(f"{n} {t}" for n, t in files.dtypes)
    return files.mapInPandas(_read, f"{columns}, content string")


def fingerprint(files: DataFrame, time: str = "mtime") -> DataFrame:
    """``(fingerprint, content_hash)`` of a manifest: number of files and latest change, ``empty`` for none.

    The fingerprint misses a change that keeps both; ``content_hash``, over all columns that a manifest has, does not.
    """
    newest = F.format_string("%d:%.6f", F.count(F.lit(1)), F.max(time))
    every = F.coalesce(F.bit_xor(F.xxhash64(*sorted(files.columns))), F.lit(0))
    return files.agg(F.when(F.count(F.lit(1)) == 0, "empty").otherwise(newest).alias("fingerprint"), every.alias("content_hash"))


def near_documentation(files: DataFrame, docs: DataFrame, budget: int = DOC_CHARS) -> DataFrame:
    """``(rel_path, docs)``: the documentation of each file's directories from its own up to the root, nearest first.

    ``docs`` has ``rel_path`` and ``content``. Texts are trimmed and added while there is room in ``budget``; the one that does
    not fit is cut and marked. Files without any have no row.
    """
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, 1, F.size(parts) - 1 - k), "/").alias("dir"), k.alias("far")))
    dirs = files.select("rel_path", F.inline(above))
    names = F.create_map(*[F.lit(x) for k, n in enumerate(DOC_NAMES) for x in (n, k)])
    own = docs.select(
        F.regexp_replace("rel_path", r"/?[^/]*$", "").alias("dir"), F.try_element_at(names, F.regexp_extract("rel_path", r"([^/]*)$", 1)).alias("rank"),
        F.col("rel_path").alias("doc"), F.trim(F.regexp_replace("content", r"^\s+|\s+$", "")).alias("text"),
    ).filter("rank IS NOT NULL AND text <> ''")
    order = Window.partitionBy("rel_path").orderBy("far", "rank")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dirs.join(own, "dir").withColumn("_before", before).filter(F.col("_before") < budget)
    room = (F.lit(budget) - F.col("_before")).cast("int")
    cut = F.when(F.length("text") > room, F.concat(F.substring("text", F.lit(1), room), F.lit("\n...(truncated)"))).otherwise(F.col("text"))
    piece = F.struct("far", "rank", F.concat(F.lit("["), "doc", F.lit("]:\n"), cut).alias("t"))
    return placed.groupBy("rel_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), "\n\n---\n\n").alias("docs"))

"""Source files that do not parse, by permissible token pairs and windowed reductions.

Each file is cut into token classes. Its distinct adjacent pairs become rows, and an anti-join with the pairs that the
language's grammar permits finds the files with a pair that no valid text has. The other files' nesting and the productions
of their statements are validated by reductions: the tokens between two brackets, or the marks of a block, are a window that
one symbol replaces if a production allows its content, from the innermost windows outwards. Where the standard library has
an exact parser, as for Python, it stands for the reductions and must confirm what the pairs say.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.grammar import END, START
from graphmill.llm.languages import lexer_of
from graphmill.llm.tables import LANGUAGES
from graphmill.session import checkpointed


def tokens_of(text: str, lang: str) -> str:
    """Token classes of a text, without line ends that mean nothing."""
    lexer, dropped = lexer_of(lang)
    tokens = lexer.lex(text)
    return dropped.sub("", tokens) if dropped else tokens


def _parses_exactly(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def token_pairs(tokens: str) -> list[str]:
    """Distinct adjacent pairs of token classes, with the text's start and end."""
    return list(set(map("".join, zip(START + tokens, tokens + END, strict=True))))


def parses(text: str, lang: str) -> bool:
    """Whether a text nests and reduces, without a look at its pairs. Python's exact parser decides alone."""
    return _parses_exactly(text) if lang == "py" else lexer_of(lang)[0].grammar.accepts(tokens_of(text, lang))


def permissible_pairs(spark: SparkSession) -> DataFrame:
    """``(lang, pair)`` of all grammars: a table of settings, some 20,000 short rows."""
    rows = [(lang, pair) for lang in sorted(set(LANGUAGES.values())) for pair in sorted(lexer_of(lang)[0].grammar.pairs())]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["lang", "pair"]))


_LEXED = "request_id bigint, lang string, tokens string, exact boolean, pairs array<string>"


def _lexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, lang, text in zip(batch["request_id"], batch["lang"], batch["code"], strict=True):
            tokens = tokens_of(text, lang)
            exact = _parses_exactly(text) if lang == "py" else None
            rows.append((key, lang, tokens, exact, token_pairs(tokens)))
        yield pd.DataFrame(rows, columns=["request_id", "lang", "tokens", "exact", "pairs"])


def _unreduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rest = [
            not lexer_of(lang)[0].grammar.accepts(tokens) if exact is None else not exact
            for lang, tokens, exact in zip(batch["lang"], batch["tokens"], batch["exact"], strict=True)
        ]
        yield batch.loc[rest, ["request_id", "lang"]]


def unparsable(files: DataFrame) -> DataFrame:
    """``(request_id, lang, by, n_pairs)`` of each file that does not parse, once: whether ``pairs`` tell so, of which it has
    ``n_pairs`` that no valid text has, or a ``reduction`` that fails although all pairs are permissible.

    ``files`` has ``request_id``, ``lang`` and ``code``. Null, empty and blank code is valid, as is code in an unknown
    language; rows without an id are left out. Other columns are ignored; an empty table gives no rows.
    """
    known = sorted(set(LANGUAGES.values()))
    texts = files.filter(F.col("lang").isin(known) & F.col("code").rlike(r"\S") & F.col("request_id").isNotNull()).select("request_id", "lang", "code")
    lexed = checkpointed(texts.mapInPandas(_lexed, _LEXED))
    rows = lexed.filter("exact IS NULL OR NOT exact").select("request_id", "lang", F.explode("pairs").alias("pair"))
    wrong = rows.join(F.broadcast(permissible_pairs(files.sparkSession)), ["lang", "pair"], "left_anti")
    told = checkpointed(wrong.groupBy("request_id", "lang").agg(F.lit("pairs").alias("by"), F.count_distinct("pair").alias("n_pairs")))
    rest = lexed.select("request_id", "lang", "tokens", "exact").join(told.select("request_id"), "request_id", "left_anti")
    failed = rest.select("request_id", "lang", "tokens", "exact").mapInPandas(_unreduced, "request_id bigint, lang string").distinct()
    return told.unionByName(failed.select("request_id", "lang", F.lit("reduction").alias("by"), F.lit(0).cast("bigint").alias("n_pairs")))


def unparsable_rates(files: DataFrame) -> DataFrame:
    """``(repo, lang, n_files, n_invalid, share)`` of each repository and language; files of no repository share a null one."""
    distinct = files.filter("request_id IS NOT NULL").select("request_id", "repo", "lang").groupBy("request_id").agg(F.max("repo").alias("repo"), F.max("lang").alias("lang"))
    flagged = unparsable(files).select("request_id", F.lit(1).alias("_wrong"))
    joined = distinct.join(flagged, "request_id", "left")
    return (
        joined.groupBy("repo", "lang")
        .agg(F.count(F.lit(1)).alias("n_files"), F.count("_wrong").alias("n_invalid"))
        .withColumn("share", F.col("n_invalid") / F.col("n_files"))
    )

"""Mixing sources to target shares of the tokens, by counts of texts per token length and bounded knapsacks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.tokenizer import VOCABULARY, token_counts
from graphmill.session import checkpointed

#: Rank buckets of a group of texts of one source and length: such a group is ranked in so many parts.
RANK_BUCKETS = 64
#: Sums that the knapsack looks at: at least, at most, and times the number of lengths.
LEAST_ROOM, MOST_ROOM, ROOM_LENGTHS = 1 << 16, 1 << 22, 1 << 31


def fill(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of ``counts[i]`` texts of ``lengths[i]`` tokens to take for a total as near below ``budget`` as found.

    A proportional part of every length first, then the longest texts that fit while much is left (one of each length,
    then more), then a bounded knapsack over all texts that fit the rest, solved exactly. What is missing is less than the
    shortest text left out.
    """
    whole = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if whole <= budget:
        return list(counts)
    taken = [c * budget // whole for c in counts]
    left = budget - sum(n * c for n, c in zip(lengths, taken, strict=True))
    room = min(4 * max(lengths), MOST_ROOM, max(LEAST_ROOM, ROOM_LENGTHS // len(lengths)))
    for most in (1, left):
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            if left <= room:
                break
            more = min(most, counts[i] - taken[i], left // lengths[i], -((room - left) // lengths[i]))
            taken[i] += more
            left -= lengths[i] * more
    if left > room:  # no other text fits
        return taken
    order = sorted(range(len(lengths)), key=lambda i: -((counts[i] * budget) % whole))
    parts: list[tuple[int, int]] = []  # (index, how many at once): powers of two bound the number of copies
    for i in order:
        most, size = min(counts[i] - taken[i], left // lengths[i]), 1
        while most > 0:
            parts.append((i, min(size, most)))
            most -= parts[-1][1]
            size *= 2
    # The part by which each sum was reached first: before it, the sum without that part was reached.
    reached = np.zeros(left + 1, bool)
    reached[0] = True
    by = np.full(left + 1, -1, np.int32)
    top = 0
    for k, (i, copies) in enumerate(parts):
        step = lengths[i] * copies
        if step <= left:
            new = np.flatnonzero(reached[: min(top, left - step) + 1] & ~reached[step : min(top, left - step) + step + 1]) + step
            reached[new] = True
            by[new] = k
            top = max(top, int(new[-1])) if len(new) else top
        if reached[left]:
            break
    while top:
        i, copies = parts[by[top]]
        taken[i] += copies
        top -= lengths[i] * copies
    return taken


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("tokens")
    lengths, counts = group["tokens"].tolist(), group["n_texts"].tolist()
    budget, repeats = int(group["_budget"].iloc[0]), int(group["max_repeats"].iloc[0])
    whole = sum(n * c for n, c in zip(lengths, counts, strict=True))
    full = min(budget // whole, repeats)
    more = fill(lengths, counts, budget - full * whole) if full < repeats else [0] * len(counts)
    return pd.DataFrame({"source": group["source"], "tokens": lengths, "_full": full, "_more": more})


def text_key(text: str) -> bytes:
    """A hash of a text without differences of white space."""
    return hashlib.sha256(" ".join(text.split()).encode()).digest()


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "_key": [text_key(t) for t in batch["text"]]})


def mix(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY, seed: int = 42, total: int | None = None) -> DataFrame:
    """``(doc_id, source, tokens, repeats)``: the texts of the mixture and how often each one stands in it.

    ``documents`` has ``doc_id`` (unique), ``text``, ``source``; ``targets`` has ``source``, ``target_share``,
    ``max_repeats``, a table of settings. Sources are compared trimmed and in lower case. Copies of a text, also with
    other white space, count as one text, which its least ``doc_id`` stands for with that row's source. ``total`` is the
    number of tokens of the mixture with all its sources; by default the largest at which every source that has texts
    reaches its share within its repeats. Texts without tokens or an id and those of other or null sources are left out: they can't
    contribute to a share. The choice depends on ``seed`` and the texts only.
    """
    targets = (
        targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
        .filter((F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    )
    named = documents.select("doc_id", F.lower(F.trim("source")).alias("source"), "text").join(targets.select("source"), "source")
    named = named.filter((F.length("text") > 0) & F.col("doc_id").isNotNull())
    keys = named.select("doc_id", "source", "text").mapInPandas(_keyed, "doc_id bigint, source string, _key binary")
    sized = keys.join(token_counts(named, "doc_id", "text", path), "doc_id").filter("tokens > 0")
    texts = checkpointed(
        sized.groupBy("_key")
        .agg(F.min_by(F.struct("doc_id", "source", "tokens"), "doc_id").alias("_r"))
        .select("_key", "_r.doc_id", "_r.source", "_r.tokens")
    )
    histogram = texts.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n_texts"))
    # One row a source from here: the window without keys reads as many rows as there are targets.
    capacity = histogram.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n_texts")).alias("_have")).join(targets, "source")
    largest = F.min(F.col("_have") * F.col("max_repeats") / F.col("target_share")).over(Window.partitionBy())
    budgets = capacity.select(
        "source",
        "max_repeats",
        F.floor(F.col("target_share") * (F.lit(total) if total is not None else largest) + F.lit(1e-6)).alias("_budget"),
    )
    plan = (
        histogram.join(budgets, "source")
        .groupBy("source")
        .applyInPandas(_plan, "source string, tokens bigint, _full bigint, _more bigint")
    )
    place = F.xxhash64(F.lit(seed), F.col("_key"))
    group = ["source", "tokens"]
    ranked = texts.withColumn("_place", place).withColumn("_bucket", F.pmod(F.col("_place"), F.lit(RANK_BUCKETS)))
    sizes = ranked.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(
        F.sum("_n").over(Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    # Where the buckets' order alone decides, nothing is sorted: only a group's boundary bucket needs ranks.
    decided = sizes.withColumn("_before", before).join(plan, group)
    rank = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy("_place", "_key"))
    chosen = ranked.join(decided, [*group, "_bucket"]).withColumn("_rank", F.col("_before") + rank)
    repeats = F.col("_full") + F.when(F.col("_rank") <= F.col("_more"), 1).otherwise(0)
    return chosen.select("doc_id", "source", "tokens", repeats.alias("repeats")).filter("repeats > 0")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, n_texts, tokens, actual_share)`` of every target, those without texts included."""
    reached = mixture.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens")
    )
    rows = targets.select(F.lower(F.trim("source")).alias("source"), "target_share").join(reached, "source", "left").fillna(0, ["n_texts", "tokens"])
    whole = F.sum("tokens").over(Window.partitionBy())
    return rows.withColumn("actual_share", F.try_divide(F.col("tokens"), whole))

"""Aggregation per key when a few keys hold most of the rows.

A frequent-items sketch (one pass, mergeable, fixed size) names every key that can hold a share of at least
``min_share``. Rows of those keys are found by a broadcast join with that list, whose length the sketch bounds, and are
spread over salts; all other rows take the ordinary shuffle. Both halves are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.session import checkpointed

#: Counters that the sketch keeps. A key it does not track has less than about 4 / SKETCH_ITEMS of all rows, which is
#: far below any share asked for (see ``heavy_candidates``).
SKETCH_ITEMS = 16384


def heavy_candidates(df: DataFrame, key: str, min_share: float = 0.01) -> DataFrame:
    """``(key, total_rows)``: a superset of the non-null keys with at least ``min_share`` of all rows of ``df``.

    The sketch's estimate is off by at most about 4 / SKETCH_ITEMS of the rows, so keys down to ``min_share`` less that
    error are kept and none is missed. At most ``2 / min_share`` rows come out whatever the size of ``df``, which makes the
    result fit for broadcasting. An empty table gives no rows.
    """
    if not 16 / SKETCH_ITEMS <= min_share <= 1:
        raise ValueError(f"min_share must be between {16 / SKETCH_ITEMS} and 1")
    top = int(2 / min_share) + 1
    sketched = df.select(F.col(key).alias("_k")).agg(
        F.expr(f"approx_top_k(_k, {top}, {SKETCH_ITEMS})").alias("top"), F.count(F.lit(1)).alias("total_rows")
    )
    rows = sketched.select(F.explode("top").alias("t"), "total_rows")
    floor = F.col("total_rows") * F.lit(min_share - 4 / SKETCH_ITEMS)
    return rows.filter(F.col("t.item").isNotNull() & (F.col("t.count") >= floor)).select(
        F.col("t.item").alias(key), "total_rows"
    )


def heavy_keys(df: DataFrame, key: str, min_share: float = 0.01) -> DataFrame:
    """``(key, n_rows, total_rows)``: exactly the non-null keys with at least ``min_share`` of all rows of ``df``.

    Rows with a null key count towards the total but are never a key. Exact: the sketch's candidates are counted.
    """
    candidates = heavy_candidates(df, key, min_share)
    counted = (
        df.select(key)
        .join(F.broadcast(candidates), key)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.max("total_rows").alias("total_rows"))
    )
    return counted.filter(F.col("n_rows") >= F.col("total_rows") * F.lit(min_share))


def skew_safe_stats(
    df: DataFrame, key: str, member: str, time: str, min_share: float = 0.01, salts: int = 64
) -> DataFrame:
    """Per non-null ``key``: ``n_rows``, ``n_members`` (distinct non-null members), ``first_time``, ``last_time``.

    Heavy keys (from the sketch) are grouped by key and a salt that the member's hash decides, so that each member falls
    into one salt and the distinct counts of the salts add up exactly; the second grouping reads at most ``salts`` rows a
    key. Other keys are grouped as usual. Rows repeated in ``df`` count as often as they stand there; null members and times
    are left out of their own figures only; extra columns are ignored; an empty table gives no rows.
    """
    slim = df.select(F.col(key).alias("_k"), F.col(member).alias("_m"), F.col(time).alias("_t"))
    # Two joins need the candidates, at most 2 / min_share rows: the sketch's pass over the rows is made once.
    heavy = F.broadcast(checkpointed(heavy_candidates(slim, "_k", min_share).select("_k")))

    def figures() -> list[Column]:
        return [
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct("_m").alias("n_members"),
            F.min("_t").alias("first_time"),
            F.max("_t").alias("last_time"),
        ]

    salted = (
        slim.join(heavy, "_k", "left_semi")
        .withColumn("_salt", F.pmod(F.xxhash64("_m"), F.lit(salts)))
        .groupBy("_k", "_salt")
        .agg(*figures())
        .groupBy("_k")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_members").alias("n_members"),
            F.min("first_time").alias("first_time"),
            F.max("last_time").alias("last_time"),
        )
    )
    rest = slim.filter(F.col("_k").isNotNull()).join(heavy, "_k", "left_anti").groupBy("_k").agg(*figures())
    return salted.unionByName(rest).withColumnRenamed("_k", key)

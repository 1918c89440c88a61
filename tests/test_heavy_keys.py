"""Skew-safe statistics against brute force, with nulls, ties, repeated rows, empty tables and extra columns."""

from collections import Counter

from graphmill.operators.heavy_keys import heavy_keys, skew_safe_stats


def rows_of():
    rows = [("hot", f"m{i % 40}", i) for i in range(500)] + [(f"k{i}", f"m{i % 3}", i) for i in range(300)] + [(None, "m", 1)] * 50
    return rows + [("k1", None, None), ("hot", "m1", 3)] + [("tie", "m", 1)] * 9


def test_stats_match_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "x") for r in rows], "key string, member string, time int, _k string")
    got = {r["key"]: (r["n_rows"], r["n_members"], r["first_time"], r["last_time"]) for r in skew_safe_stats(df, "key", "member", "time").collect()}
    want = {}
    for key in {r[0] for r in rows if r[0]}:
        own = [r for r in rows if r[0] == key]
        times = [r[2] for r in own if r[2] is not None]
        want[key] = (len(own), len({r[1] for r in own if r[1]}), min(times), max(times))
    assert got == want


def test_heavy_keys_are_exact(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "key string, member string, time int")
    counts = Counter(r[0] for r in rows)
    want = {k for k, n in counts.items() if k and n >= 0.01 * len(rows)}
    assert {r["key"] for r in heavy_keys(df, "key", 0.01).collect()} == want
    assert heavy_keys(df.limit(0), "key").count() == 0 and skew_safe_stats(df.limit(0), "key", "member", "time").count() == 0

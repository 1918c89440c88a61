"""Every registered query with SQL gives the same rows as DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphmill.plans import all_sql

DATA = "/root/testdata/sf0.001"
SQL = all_sql()
#: The cheaper half of the graph queries; the others are compared on the driver's tables.
NAMES = sorted(set(SQL) - {"depth_layout", "cycle_only", "cycle_show", "reverse_flow_edges", "folder_components"})


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame):
    def one(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        return round(v, 6) if isinstance(v, float) and v == v else None if v != v else v

    return sorted(str(tuple(map(one, r))) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [r.replace("None", "nan").replace("<NA>", "nan") for r in rows(got)] == [r.replace("None", "nan").replace("<NA>", "nan") for r in rows(want)]

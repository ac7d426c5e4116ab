"""Every query against its SQL, over whole small tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from arclume.plans import problems
from arclume.plans.registry import ORACLES, QUERIES

ALL, SQL = problems.queries() | QUERIES, ORACLES | problems.ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = ALL[name](spark, SF)
    want = duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert ALL[name](spark, SF).count() > 0


def test_contract(spark):
    names = entry_module.queries()
    assert set(entry_module.oracle_sql()) <= set(names)
    rows = entry_module.entry(spark).collect()
    assert sorted(r.method for r in rows) == ["M1", "M2", "M3"]
    assert all(0 <= r[c] <= 1 for r in rows for c in ("frame_ap", "frame_auc"))
    # null where all videos are of one class, as on the smallest tables
    assert all(r.video_auc is None or 0 <= r.video_auc <= 1 for r in rows)

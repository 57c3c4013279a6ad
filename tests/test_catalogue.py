"""Every catalogue query against its SQL oracle on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from voxmill.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(float(v))
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_like_sql(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(plain(v) for v in row) for row in cur.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in got.collect()) == want


#: Queries that SQL can't say, and the tests that hold their operators against plain versions.
ELSEWHERE = {"decompose_fragments", "qem_decimate", "simplify_smooth", "repair", "skel_rdp", "multires_pipeline", "skeleton_pipeline", "mesh_metric_table"}


def test_all_other_queries_have_tests_of_their_own():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) == ELSEWHERE


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every query with SQL gives the rows of its SQL on the smallest tables; every other one runs."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows

SF = "/root/testdata/sf0.001"
CORE = {n: s for s in __import__("sieveline.plans", fromlist=["x"]).query_sets() for n in s.queries}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        rel = db.sql(sql)
        assert sorted(df.columns) == sorted(rel.columns)
        assert got == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_queries_stay_where_a_library_is_missing():
    """Queries of subpackages that can't be imported are left out, the others are there."""
    import subprocess
    import sys

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p5_found' in q and 'p6_ids' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))

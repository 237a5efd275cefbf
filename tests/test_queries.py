"""Every registered query beside its SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

import __spark_entry__ as entry
from checks.compare import canonical

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(os.path.join(SF, "*.parquet")):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert rows and len({c for c in df.columns}) == len(df.columns)
        return
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(cur.fetchall(), cols)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

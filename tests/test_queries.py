"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from brindle.catalogue import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(REGISTRY.queries()))
def test_query(spark, duck, name):
    got = REGISTRY.queries()[name](spark, SF).toPandas()
    sql = REGISTRY.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.sql(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=False, rtol=1e-9)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert sorted(r.label for r in rows) == ["A", "N", "R"] and all(0 < r.ap < 1 for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_needs_no_session():
    """The driver lists the queries before it starts a session."""
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert done.returncode == 0, done.stderr

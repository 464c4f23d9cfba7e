import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, data, name):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = entry.queries()[name](spark, data)
    want = c.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = Counter(tuple(map(str, r)) for r in got.select(*want.columns).collect())
    assert rows == Counter(tuple(map(str, r)) for r in want.fetchall())


def test_core_needs_no_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['siltstone.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('p8') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))

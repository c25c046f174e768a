"""A sample of the registered queries against DuckDB on the smallest tables; all of them run in the driver's check."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from vectrove.plans import catalogue

SF = "/root/testdata/sf0.001"
SAMPLE = [n for n in catalogue.ORACLE_SQL if n.startswith(("topk_", "dist_", "batch", "read_by", "rel_join", "rel_groups", "rel_dialect", "rel_string", "rel_regex", "compact", "insert_", "fn_"))]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return "[" + ",".join(map(norm, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_against_oracle(spark, duck, name):
    rows = catalogue.QUERIES[name](spark, SF).collect()
    result = duck.execute(catalogue.ORACLE_SQL[name])
    columns = sorted(d[0] for d in result.description)
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted(tuple(norm(r[i]) for i in order) for r in result.fetchall())
    assert sorted(tuple(norm(r[c]) for c in columns) for r in rows) == want


def test_entry(spark):
    assert entry_module.entry(spark).count() == 10
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())

import glob
import os

import pytest

from tarnfold.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cur = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    show = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    got = sorted(tuple(show(r[c]) for c in sorted(columns)) for r in df.collect())
    want = sorted(tuple(show(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.entry(spark).columns) == {"chunk_id", "score"}
    assert set(entry.oracle_sql()) <= set(entry.queries())

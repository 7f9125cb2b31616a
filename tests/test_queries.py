"""Every query against its SQL on a small scale; those without SQL must run."""

import duckdb
import pytest
from conftest import DATA, rows_of

import __spark_entry__ as entry

NAMES = sorted(n for n in entry.catalog.QUERIES)


@pytest.fixture(scope="module")
def duck():
    import glob
    import os

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    if name in entry.oracle_sql():
        assert rows_of(got) == rows_of(duck.execute(entry.oracle_sql()[name]).df())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0

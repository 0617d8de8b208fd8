"""Every registered query with SQL gives what DuckDB gives, on the smallest tables."""

import glob
import os

import pytest

from corpusloom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def rows(columns, records):
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, float):
            return round(v, 6)
        return v if isinstance(v, (int, bool, str)) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([plain(r[i]) for i in order]) for r in records)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(catalogue.ORACLE_SQL[name])
    want = rows([d[0] for d in found.description], found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0

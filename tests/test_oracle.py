"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import TABLES, _digest
from medlattice.plans import ORACLES, QUERIES
from tests.conftest import SMALL_SF

NAMES = sorted(set(ORACLES) & set(QUERIES))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL_SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SMALL_SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


def test_every_query_has_a_callable_and_entry_runs(spark):
    qs = E.queries()
    assert len(qs) >= 60
    assert set(E.oracle_sql()) <= set(qs)
    out = E.entry(spark)
    assert out.count() > 0
    assert "status" in out.columns


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SMALL_SF).count() > 0

"""Results must not depend on the session time zone: NTZ wall-clock
arithmetic, day truncation and stream windows are zone-free."""

import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import TABLES, _digest
from medlattice.plans import ORACLES, QUERIES
from tests.conftest import SMALL_SF

# every query whose result holds or compares times
TIME_SENSITIVE = sorted(n for n, sql in ORACLES.items()
                        if n in QUERIES and any(w in sql for w in ("time", "date", "created_at", "day")))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL_SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", TIME_SENSITIVE)
def test_non_utc_session_matches_oracle(spark, con, name):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = E.queries()[name](spark, SMALL_SF)
        rows = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert _digest(df.columns, rows) == _digest(ocols, cur.fetchall())

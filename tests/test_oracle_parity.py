"""Every query with oracle SQL must match DuckDB on the sf0.01 tables (the driver's gate)."""

import os

import duckdb
import pytest

from tabwright.plans.contracts import TABLES
from tabwright.plans.registry import ORACLE, QUERIES, load_all

from tools.oracle_check import fingerprint

load_all()
SF = os.environ.get("TABWRIGHT_ORACLE_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, key):
    sp = QUERIES[key](spark, SF).toPandas()
    dk = con.execute(ORACLE[key]).df()
    assert fingerprint(sp) == fingerprint(dk)


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert df.columns == ["period", "label", "n", "pct"]
    assert len(rows) > 0
    assert set(e.oracle_sql()) <= set(e.queries())

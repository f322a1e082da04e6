"""Every registered query against its DuckDB oracle (sf0.001), plus the
driver contract."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.check_oracle import TABLES, digest

from usagelens.plans import oracle
from usagelens.plans.registry import REGISTRY as QUERIES

ORACLE = oracle.build()
FAST = [n for n in QUERIES if not n.startswith("stream_")]
STREAM = [n for n in QUERIES if n.startswith("stream_")]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(ORACLE) == set(QUERIES)  # every registered query has oracle SQL
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def _check(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    _check(spark, con, name)


@pytest.mark.parametrize("name", STREAM)
def test_stream_matches_batch(spark, con, name):
    _check(spark, con, name)

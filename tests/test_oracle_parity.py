"""Every registered query against its DuckDB oracle on the smallest fixture (sf0.001)."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.compare import RAW, rows_of

from .conftest import SF001

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in RAW:
        p = os.path.join(SF001, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF001)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    rel = duck.sql(ORACLES[name])
    dcols = rel.columns
    drows = [dict(zip(dcols, r)) for r in rel.fetchall()]
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    cols = sorted(dcols)
    assert rows_of(srows, cols) == rows_of(drows, cols)


def test_every_query_runs(spark):
    """Queries without an oracle (streaming, file-writing, fold-only) still run and keep their schema."""
    for name, job in E.queries().items():
        if name in ORACLES:
            continue
        df = job(spark, SF001)
        assert df.count() >= 0, name


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 5

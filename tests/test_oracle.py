"""T2: every registered query with an oracle matches DuckDB on sf0.001
(row count, column names, values rounded as the registry rounds them)."""

import math
import os

import duckdb
import pytest

from conftest import SF_SMALL
from strata.plans import registry
from strata.sources.fixtures import BASE_TABLES

ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def _rows(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    q = registry.queries()[name]
    sdf = q(spark, SF_SMALL)
    srows = [r.asDict() for r in sdf.collect()]
    rel = con.sql(ORACLE[name])
    dcols = rel.columns
    drows = [dict(zip(dcols, r)) for r in rel.fetchall()]
    assert sorted(c.lower() for c in sdf.columns) == sorted(c.lower() for c in dcols)
    cols = sorted(sdf.columns)
    dmap = {c.lower(): c for c in dcols}
    drows = [{c: r[dmap[c.lower()]] for c in cols} for r in drows]
    assert len(srows) == len(drows)
    assert _rows(srows, cols) == _rows(drows, cols)

"""The correctness gate on the driver tables: every registered query against its DuckDB SQL
(sf0.001, whole tables), compared row by row after the shared rounding."""

import math

import duckdb
import pytest

from wattlens import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(rs):
    out = []
    for r in rs:
        out.append(tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r))
    return sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t))


def test_every_query_has_oracle_sql():
    assert set(catalog.oracle_sql()) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = catalog.run(spark, name, SF)
    rel = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    expected = [tuple(r[i] for i in order) for r in rel.fetchall()]
    got = _norm(tuple(r) for r in df.collect())
    assert got == _norm(expected)


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["tech", "year", "capacity"] and df.count() > 0
    assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every registered text query that SQL can express, against DuckDB on whole tables."""

import hashlib

import duckdb
import pytest

from wattlens.llm import queries

from .test_repeats import cover

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    got = sorted(tuple(r[c] for c in cols) for r in df.collect())
    assert got == sorted(tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall())


def test_op6_matches_brute_force(spark):
    data = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, len(b), len(g), sum(k - 1 not in g for k in g), hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in g)).hexdigest())
                  for (i, b), g in zip(data, cover(data)))
    assert any(w[2] for w in want)
    assert sorted(map(tuple, queries.op6_suffix_dedup(spark, SF).collect())) == want

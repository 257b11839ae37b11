"""Corpus queries that SQL can express, against it."""

import duckdb
import pytest

from weftgraph.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    rel = duck.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    assert got == sorted(str(r) for r in rel.project(",".join(f'"{c}"' for c in cols)).fetchall())

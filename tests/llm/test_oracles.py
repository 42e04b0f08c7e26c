import os

import duckdb
import pytest

from findings_engine.llm.registry import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_oracle(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.sql(oracle_sql()[name])
    assert sorted(rel.columns) == columns
    want = sorted(repr(tuple(r[rel.columns.index(c)] for c in columns)) for r in rel.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want

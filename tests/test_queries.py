import os

import duckdb
import pytest

from findings_engine.queries import oracle_sql, queries
from findings_engine.streaming.history import dedup_stream

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_equals_oracle(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.sql(oracle_sql()[name])
    assert sorted(rel.columns) == columns
    want = sorted(repr(tuple(r[rel.columns.index(c)] for c in columns)) for r in rel.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_history_stream(spark, tmp_path):
    source, history = str(tmp_path / "in"), str(tmp_path / "history")
    schema = "key string, pos long"
    for rows in ([("a", 1), ("b", 2), ("a", 3)], [("b", 4), ("c", 5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        dedup_stream(stream, history, str(tmp_path / "cp"), "key", "pos").awaitTermination(60)
    assert sorted((r.key, r.pos) for r in spark.read.parquet(history).collect()) == [("a", 1), ("b", 2), ("c", 5)]

"""Registered queries against their SQL twins, and the shape of the native plans."""

import duckdb
import pytest

import corpus_pipeline
from ratecheck.llm import catalog

TABLES = "documents pages benchmark labels embeddings conversations".split()
NATIVE = ("op2_source_mix", "op6_shards", "op8_line_rules", "op9_phrase_index")


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return con


def test_all_and_the_pipeline_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "near-duplicates", "decontamination", "source mix", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, data, name):
    frame = catalog.QUERIES[name](spark, data)
    columns = sorted(frame.columns)
    got = sorted(tuple(repr(r[c]) for c in columns) for r in frame.collect())
    cursor = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(repr(r[i]) for i in at) for r in cursor.fetchall())
    assert got
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in NATIVE:
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

"""Every registered query against its SQL twin, and the shape of every plan."""

import decimal
import re

import duckdb
import pytest

import __spark_entry__ as entry_module
from ratecheck.plans.driver_views import DriverViews

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES = {k: v for c in entry_module.CATALOGS for k, v in c.QUERIES.items()}
ORACLE = {k: v for c in entry_module.CATALOGS for k, v in c.ORACLE.items()}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    return f"{type(value).__name__} {value}"


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, data, name):
    frame = QUERIES[name](spark, data)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    assert got == want
    assert got
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan


def test_entry(spark):
    frame = entry_module.entry(spark)
    assert frame.columns == ["doc_id", "total_parts", "passed_parts", "failed_parts",
                             "unknown_parts"]
    assert frame.count() > 0


def scans(frame, column):
    """How many relations with a column the plan reads, those behind kept frames left out."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(rf"\bRelation \[[^\]]*\b{column}\b", plan))


@pytest.mark.parametrize("name", ["f2_invoice_report", "f3_batch_report", "f6_text_report"])
def test_reports_read_the_lines_once(spark, data, name):
    spark.catalog.clearCache()
    assert scans(QUERIES["f1_line_report"](spark, data), "l_linenumber") == 1
    assert scans(QUERIES[name](spark, data), "l_linenumber") == 0


@pytest.mark.parametrize("name", ["f2_invoice_report", "f3_batch_report", "f6_text_report"])
def test_reports_keep_no_columns_they_do_not_show(spark, data, name):
    spark.catalog.clearCache()
    plan = QUERIES[name](spark, data)._jdf.queryExecution().withCachedData().toString()
    kept = [x for x in re.findall(r"InMemoryRelation \[(.*?)\]", plan) if "raw_text" in x]
    assert kept
    assert not any(c in x for x in kept
                   for c in ("composite_key", "validation_errors", "price_difference"))


@pytest.mark.parametrize("name", ["e8_file_outcomes", "e9_folder_statistics"])
def test_counters_take_verdicts_and_gate_from_one_aggregate(spark, data, name):
    """The lines are read once for the verdicts, beside what the invoice view itself reads."""
    spark.catalog.clearCache()
    own = scans(DriverViews(spark, data).invoices(), "l_linenumber")
    assert scans(QUERIES[name](spark, data), "l_linenumber") == own + 1


def test_known_keys_leave_before_lines_are_compared(spark, data):
    plan = QUERIES["e1_unknown_parts"](spark, data)._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    assert text.index("Aggregate") < text.index("LeftAnti")

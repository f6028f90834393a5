"""Verdicts, reports and invoice rules on the example rows, and the decided traps."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ratecheck.functions.keys import composite_key, strip
from ratecheck.operators import invoices as inv
from ratecheck.operators import lines as li
from ratecheck.operators import validate as val
from ratecheck.plans import report as rep
from ratecheck.plans.driver_views import DriverViews
from ratecheck.schemas import INVOICE_LINES, PARTS
from ratecheck.sinks import exports
from ratecheck.sources import records

AS_OF = "2025-01-31 00:00:00"


def part(key, number, price, description=None, kind=None, active=True, category=None):
    return (key, number, Decimal(price), description, kind, category, "manual", None, None, None,
            active, None)


@pytest.fixture(scope="module")
def master(spark):
    return spark.createDataFrame([
        part("RENT|SHIRT WORK LS BTN COTTON|GS0448", "GS0448", "0.3000",
             "SHIRT WORK LS BTN COTTON", "Rent"),
        part("RENT|PANTS WORK NAVY|GP0171NAVY", "GP0171NAVY", "10.0000", "PANTS WORK NAVY", "Rent",
             active=False),
    ], PARTS)


def line(no, number, description, rate, quantity=1, total=None, kind="Rent", doc="d1"):
    money = None if rate is None else Decimal(rate)
    return (doc, no, str(no), str(no), number, description, kind, money, quantity,
            None if total is None else Decimal(total), f"raw {no}")


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([
        line(1, "GS0448", "  shirt work  ls btn cotton ", "0.3000", 15, "4.50"),
        line(2, "gs0448", "SHIRT WORK LS BTN COTTON", "0.3010", 1, "0.30"),
        line(3, "GP0171NAVY", "PANTS WORK NAVY", "10.0010"),
        line(4, "GP0171NAVY", "PANTS WORK NAVY", None),
        line(5, None, "PREP CHARGE", "1.0000"),
        line(6, "NEW1", "JACKET", "0.7500", 2, "1.50"),
        line(7, "NEW1", "JACKET", "0.9000", 2, "0"),
    ], INVOICE_LINES)


def verdict_by_line(frame):
    return {r.line_id: r for r in frame.collect()}


def test_tolerance_is_tested_on_floats(lines, master):
    got = verdict_by_line(val.line_verdicts(lines, master))
    # 0.301 against 0.300 is over 0.001 as floats, 10.001 against 10.0 is not.
    assert got["1"].validation_status == "PASSED"
    assert got["2"].validation_status == "FAILED"
    assert got["3"].validation_status == "PASSED"
    assert got["4"].validation_status == "PASSED"
    assert got["5"].validation_errors == ["Missing part number"]
    assert got["6"].validation_status == "UNKNOWN"


def test_inactive_parts_match_unless_asked(lines, master):
    got = verdict_by_line(val.line_verdicts(lines, master, active_only=True))
    assert got["3"].validation_status == "UNKNOWN"


def test_counts_add_up(lines, master):
    row = val.batch_summary(val.line_verdicts(lines, master)).first()
    assert row.total_parts == 7 == row.passed_parts + row.failed_parts + row.unknown_parts
    assert row.error_lines == 4


def test_first_seen_price_judges_later_lines(lines, master):
    got = verdict_by_line(val.verdicts_with_acceptance(lines, master, AS_OF))
    assert got["6"].validation_status == "PASSED"
    assert got["7"].validation_status == "FAILED"


def test_error_line_money(lines, master):
    got = {r.line_id: r for r in val.error_lines(val.line_verdicts(lines, master)).collect()}
    assert got["7"].actual_total == Decimal("1.8000")  # total 0 is price x quantity
    assert got["7"].expected_total == got["7"].actual_total
    assert got["2"].expected_total == Decimal("0.3000")
    assert set(got) == {"2", "5", "6", "7"}


def test_sub_totals_add_up_to_the_grand_total(spark, lines, master):
    other = lines.withColumn("doc_id", F.lit("d2"))
    invoices = spark.createDataFrame(
        [("d1", "10000001", "01/15/2025"), ("d2", "10000002", None)],
        "doc_id string, invoice_number string, invoice_date string")
    verdicts = val.line_verdicts(lines.unionByName(other), master)
    rows = rep.in_report_order(rep.batch_report(verdicts, invoices)).collect()
    assert rows[-1].line_number == "GRAND TOTAL"
    assert [r.sort_block for r in rows] == ([0] * 7 + [1, 2]) * 2 + [3]

    def money(text):
        return Decimal(text.replace("$", ""))

    subs = [money(r.actual_total) for r in rows if r.line_number == "SUB-TOTAL"]
    assert sum(subs) == money(rows[-1].actual_total)
    blank = [r for r in rows if r.sort_block == 2][0]
    assert set(blank[4:]) == {""}


def test_written_reports_keep_their_order(spark, lines, master, tmp_path):
    invoices = spark.createDataFrame([("d1", "10000001", "01/15/2025")],
                                     "doc_id string, invoice_number string, invoice_date string")
    verdicts = val.line_verdicts(lines, master)
    exports.write_report(rep.batch_report(verdicts, invoices), str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.count() == 10
    sections = spark.createDataFrame([("d1", "SUBTOTAL", 1, Decimal("100.0000"))],
                                     "doc_id string, section_type string, section_pos int, "
                                     "amount decimal(18,4)")
    exports.write_text_report(rep.text_report(verdicts, invoices, sections, AS_OF),
                              str(tmp_path / "txt"))
    text = [r.value for r in spark.read.text(str(tmp_path / "txt")).collect()]
    assert text[0] == "INVOICE VALIDATION REPORT"
    assert "Subtotal: $100.00" in text
    assert text[-2].startswith("Error Rate: ")


def test_long_invoices_nest_in_pages(spark, lines, master):
    invoices = spark.createDataFrame([("d1", "10000001", "01/15/2025")],
                                     "doc_id string, invoice_number string, invoice_date string")
    verdicts = val.line_verdicts(lines, master)
    rows = records.nest_verdicts(verdicts, invoices, size=3).orderBy("page").collect()
    assert len(rows) > 1
    assert [p.line_number for r in rows for p in r.parts] == ["1", "2", "3", "4", "5", "6", "7"]
    assert [r.validation_summary is not None for r in rows] == [True] + [False] * (len(rows) - 1)
    assert rows[0].validation_summary.total_parts == 7


def test_records_read_back_alike_for_any_page_size(spark, data):
    """Lines, sections and what is checked on them do not depend on the page size."""
    views = DriverViews(spark, data)

    def read_back(size):
        nested = records.nest_extractions(views.lines(), views.invoices(), views.sections(), size)
        back = records.parse_extractions(records.to_text(nested))
        lines, sections = records.flat_lines(back), records.flat_sections(back)
        assert lines.groupBy("doc_id", "row_idx").count().filter("count > 1").isEmpty()
        return [sorted(map(str, df.collect())) for df in (
            lines, sections, inv.totals_check(sections), inv.section_order(sections))]

    assert read_back(2) == read_back(10_000)


def test_key_normalization_is_idempotent(spark):
    frame = spark.createDataFrame([(" ren\tt ", "a  b\n", " x ")], "t string, d string, n string")
    key = frame.select(composite_key("t", "d", "n").alias("k")).first().k
    assert key == "REN T|A B|X"
    again = spark.createDataFrame([tuple(key.split("|"))], "t string, d string, n string")
    assert again.select(composite_key("t", "d", "n").alias("k")).first().k == key
    assert frame.select(strip("n").alias("s")).first().s == "x"


def test_sections(spark):
    rows = [("a", "SUBTOTAL", 1, "100.00"), ("a", "FREIGHT", 2, "10.00"), ("a", "TAX", 3, "5.00"),
            ("a", "TOTAL", 4, "115.00"),
            ("b", "FREIGHT", 1, "10.00"), ("b", "SUBTOTAL", 2, "100.00"), ("b", "TAX", 3, "5.00"),
            ("b", "TOTAL", 4, "116.00"), ("c", "TOTAL", 1, "1.00")]
    sections = spark.createDataFrame(
        [(d, t, p, Decimal(a)) for d, t, p, a in rows],
        "doc_id string, section_type string, section_pos int, amount decimal(18,4)")
    totals = {r.doc_id: r for r in inv.totals_check(sections).collect()}
    assert totals["a"].totals_valid and not totals["b"].totals_valid
    assert totals["b"].discrepancy == 1 and totals["c"].discrepancy is None
    order = {r.doc_id: r.sequence_valid for r in inv.section_order(sections).collect()}
    assert order == {"a": True, "b": False, "c": False}


def test_rate_and_quantity_of_raw_text(spark):
    raw = ("1 | Anthony Carson | GP1212NAVY | PANT FR CARGO DRIFIRE |  | 38X34 | Rent |  | 11 "
           "| 1.150 | 12.65")
    frame = spark.createDataFrame([(raw,), ("a | b",), (None,)], "t string")
    got = [r.r for r in frame.select(li.rate_and_quantity("t").alias("r")).collect()]
    assert (got[0].rate, got[0].quantity) == (1.15, 11)
    assert (got[1].rate, got[2].quantity) == (None, None)


def test_strict_folders_refuse_failures(spark):
    outcomes = spark.createDataFrame(
        [("d1", "f", True, 1, 0, 0, None), ("d2", "f", False, 0, 0, 0, "No line items found")],
        "doc_id string, folder string, success boolean, lines bigint, unknown_parts bigint, "
        "validation_errors bigint, error string")
    assert val.folder_statistics(outcomes).first().failed_files == 1
    with pytest.raises(ValueError):
        val.folder_statistics(outcomes, continue_on_error=False)


def test_hot_key_is_split_and_whole(spark, master):
    """A third of the lines bill one part: AQE splits that partition, and no line is lost."""
    n = 30_000
    wide = spark.range(n).selectExpr(
        "concat('d', id) AS doc_id", "id AS row_idx", "CAST(id AS STRING) AS line_id",
        "'1' AS line_number",
        "CASE WHEN id % 3 = 0 THEN 'GS0448' ELSE concat('X', id) END AS part_number",
        "'SHIRT WORK LS BTN COTTON' AS description", "'Rent' AS item_type",
        "CAST(0.3 AS DECIMAL(18,4)) AS rate", "1 AS quantity", "CAST(0.3 AS DECIMAL(18,4)) AS total",
        "repeat('x', 100) AS raw_text")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, value in settings.items():
            spark.conf.set(k, value)
        verdicts = val.line_verdicts(wide.repartition(8), master)
        counts = {r.validation_status: r["count"]
                  for r in verdicts.groupBy("validation_status").count().collect()}
        assert counts == {"PASSED": n // 3, "UNKNOWN": n - n // 3}
        verdicts = val.line_verdicts(wide.repartition(8), master).select("doc_id", "raw_text",
                                                                        "validation_status")
        verdicts.collect()
        plan = verdicts._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, value in old.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def test_large_numbers_neither_abort_nor_vanish(spark, master):
    frame = spark.createDataFrame(
        [("d1", 1, "1", "NEW1", "BIG", "Rent", "12345678901.2345", "3000000000", None),
         ("d1", 2, "2", "NEW2", "ODD", "Rent", "0.5", "2.9", "1.00")],
        "doc_id string, row_idx bigint, line_id string, part_number string, description string, "
        "item_type string, rate string, quantity string, total string")
    lines = li.normalize_lines(frame)
    rows = lines.orderBy("row_idx").collect()
    assert [r.quantity for r in rows] == [3_000_000_000, 2]
    assert rows[0].total == Decimal("12345678901.2345") * 3_000_000_000
    verdicts = val.verdicts_with_acceptance(lines, master, AS_OF)
    assert {r.validation_status for r in verdicts.collect()} == {"PASSED"}
    assert val.line_amounts(val.line_verdicts(lines, master)).count() == 2


def test_first_lines_are_picked_before_they_meet_the_master(spark, master):
    """Lines of a key fall together first, so the lookup of unknown parts sees one row a key."""
    lines = spark.range(100).selectExpr(
        "concat('d', id) AS doc_id", "id AS row_idx", "CAST(id AS STRING) AS line_id",
        "concat('X', id % 3) AS part_number", "'SHIRT' AS description", "'Rent' AS item_type")
    found = val.unknown_parts(lines, master)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftAnti") < plan.index("Aggregate")
    assert sorted((r.part_number, r.row_idx) for r in found.collect()) == [
        ("X0", 0), ("X1", 1), ("X2", 11)]  # d11 comes before d2


def test_combining_first_lines_leaves_out_columns_behind_the_needed_ones(spark, master):
    """Raw text and totals of all lines are not sorted; ties still fall to the columns in order."""
    lines = spark.createDataFrame(
        [("d1", 0, "0", n, "X1", "SHIRT", "Rent", r, t, w) for n, r, t, w in [
            ("2", "1.00", "9.00", "a"), ("1", "3.00", "1.00", "z"), ("1", "2.00", "5.00", "m"),
            ("1", "2.00", None, "k"), (None, "7.00", "4.00", "b")] for _ in range(2)],
        "doc_id string, row_idx bigint, line_id string, line_number string, part_number string, "
        "description string, item_type string, rate string, total string, raw_text string")
    whole = val.unknown_parts(lines, master)
    narrow = val.unknown_parts(lines, master, ["rate"])
    assert narrow.columns == [c for c in whole.columns if c not in ("total", "raw_text")]
    assert narrow.collect() == whole.select(*narrow.columns).collect()
    assert narrow.first().rate == "7.00"
    accepted = val.verdicts_with_acceptance(lines, master, AS_OF)
    for frame in (narrow, accepted):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        struct = plan[plan.index("min(struct(doc_id"):].split("\n")[0]
        assert "raw_text" not in struct and "total" not in struct


def test_nested_lines_travel_once(spark):
    """Neither extraction records nor nested verdicts shuffle gathered lines again."""
    lines = spark.createDataFrame(
        [("a", 1, "1"), ("a", 0, "0"), ("b", 0, "0")], "doc_id string, row_idx bigint, line_id string"
    ).selectExpr(
        "*", "'P' AS part_number", "CAST(1 AS DECIMAL(18,4)) AS rate", "'x' AS description",
        "'Rent' AS item_type", "line_id AS line_number", "1 AS quantity",
        "CAST(1 AS DECIMAL(18,4)) AS total", "'RAW' AS raw_text")
    invoices = spark.createDataFrame(
        [("a", "1", "d", "c"), ("a", "2", "d", "c")],
        "doc_id string, invoice_number string, invoice_date string, customer_number string")
    sections = spark.createDataFrame(
        [], "doc_id string, section_type string, section_pos int, amount decimal(18,4)")
    nested = records.nest_extractions(lines, invoices, sections)
    # Two invoice rows of one document: its lines stand for each, in line order.
    got = {(r.doc_id, r.invoice_metadata.invoice_number): [
        (p.lineitem_fields.line_number, p.database_fields.first_seen_invoice) for p in r.parts]
        for r in nested.collect()}
    both = [("0", "1"), ("0", "2"), ("1", "1"), ("1", "2")]
    assert got == {("a", "1"): both, ("a", "2"): both, ("b", None): [("0", None)]}

"""Discovery log, rules, settings and document text on the example rows."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ratecheck.functions import checks, text
from ratecheck.operators import log as dl
from ratecheck.operators import rules
from ratecheck.operators import text_lines as tl
from ratecheck.schemas import DISCOVERY_LOG

AS_OF = "2025-01-31 12:00:00"


@pytest.fixture(scope="module")
def log(spark):
    def row(i, part, action, invoice, price, session, day, notes=None):
        return (i, part, invoice, None, None if price is None else Decimal(price), None, action,
                None, datetime.datetime(2025, 1, day, 8), session, notes)

    return spark.createDataFrame([
        row(1, "DISCOVERED001", "discovered", "INV001", "12.50", "session_001", 15, "a"),
        row(2, "DISCOVERED002", "discovered", "INV001", "18.75", "session_001", 15),
        row(3, "DISCOVERED003", "discovered", "INV002", "22.00", "session_002", 16),
        row(4, "DISCOVERED001", "added", "INV003", "12.50", "session_003", 17),
        row(5, "DISCOVERED001", "skipped", None, None, None, 24),
    ], DISCOVERY_LOG)


def test_cutoff_day_is_kept_whole(log):
    assert dl.filter_log(log, AS_OF, days_back=7).count() == 1
    assert dl.filter_log(log, AS_OF, days_back=0).count() == 5
    assert dl.removed_count(log, AS_OF, 15).first().removed == 2
    assert dl.retained(log, AS_OF, 15).count() == 3


def test_sessions_count_nulls_only_in_the_stats(log):
    assert dl.window_summary(log, AS_OF, 30).first().sessions == 3
    stats = dl.discovery_stats(log).first()
    assert stats.active_sessions == 4
    assert stats.success_rate == 50.0
    empty = dl.discovery_stats(log.filter("false")).first()
    assert (empty.total_discoveries, empty.success_rate, empty.active_sessions) == (0, 0.0, 0)


def test_review_statistics(spark):
    frame = spark.createDataFrame(
        [(1, "PART1", "I1", Decimal("10.00")), (2, "PART1", "I2", Decimal("12.00")),
         (3, "PART2", "I1", Decimal("15.00")), (4, "PART3", None, None)],
        "id bigint, part_number string, invoice_number string, discovered_price decimal(10,4)")
    got = {r.part_number: r for r in dl.unknown_review(frame).collect()}
    one = got["PART1"]
    assert (one.occurrences, one.avg_price, one.min_price, one.max_price, one.price_variance) == (
        2, 11, 10, 12, 2)
    assert (got["PART3"].avg_price, got["PART3"].min_price) == (0, None)


def test_candidate_policies(log):
    for policy, want in (("avg", "12.5000"), ("min", "12.5000"), ("max", "12.5000")):
        row = dl.candidate_prices(log, policy).filter("part_number = 'DISCOVERED001'").first()
        assert row.authorized_price == Decimal(want)
    given = dl.candidate_prices(log, "given", "3.25").first()
    assert given.authorized_price == Decimal("3.2500")


def test_bad_entries_do_not_reach_the_log(spark, log):
    bad = log.limit(1).withColumn("action_taken", F.lit("collected"))
    assert dl.append_log(log, bad, AS_OF).count() == 5
    assert dl.rejected_entries(bad).first().errors[0].startswith("Action taken must be")
    fresh = log.limit(1).withColumn("discovery_date", F.lit(None).cast("timestamp"))
    stamped = dl.accepted_entries(fresh, AS_OF, "s9").first()
    assert stamped.processing_session_id == "s9" and stamped.discovery_date is not None


def test_session_list_counts_whole_sessions(log):
    whole = {r.processing_session_id: r["count"]
             for r in log.groupBy("processing_session_id").count().collect()}
    got = dl.recent_sessions(log, len(whole)).collect()
    assert {r.session_id for r in got} == set(whole)
    assert [r.session_id for r in dl.recent_sessions(log, 1).collect()] == [None]
    first = {r.processing_session_id: r.d for r in log.groupBy("processing_session_id").agg(
        F.min("discovery_date").alias("d")).collect()}
    assert {r.session_id: r.first_seen for r in got} == first
    assert dl.session_summaries(log, "session_001").first().unique_parts_discovered == 2
    assert dl.part_history(log.selectExpr("part_number AS composite_key", "part_number",
                                          "authorized_price").limit(1), log).count() == 3


@pytest.mark.parametrize("rule,good,bad", [
    (checks.part_number_error, ["GP0171NAVY", " item-1 ", "a.b"], ["", " ", "x", "invalid!", "A" * 21]),
    (checks.description_error, ["abc", " abc "], ["", "ab", "x" * 201]),
    (checks.price_error, ["15.50", "$1,234.5", "0.01"], [None, "x", "0", "-1", "1.00000", "0.001",
                                                         "1000000"]),
    (checks.email_error, ["A.b@x.org"], ["", "a@b", "a@b.c"]),
    (checks.date_error, ["2025-01-31", "1/2/2025", "01-02-2025"], ["", "2025/01/31", "1-2-2025"]),
    (checks.integer_error, ["1", " 7 ", "+3"], ["0", "-1", "1.0", "x", None]),
    (checks.key_name_error, ["price_tolerance", "A1"], ["", "1a", "a-b", "a" * 51]),
    (checks.session_id_error, ["session-01"], ["", "short", "with_underscore", "a" * 51]),
])
def test_value_rules(spark, rule, good, bad):
    frame = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad],
                                  "v string, ok boolean")
    wrong = frame.filter(rule("v").isNull() != F.col("ok")).collect()
    assert wrong == []


def test_dates_and_numbers_of_invoices(spark):
    frame = spark.createDataFrame([("01/15/2025 late", "12345678"), ("2025.01.15", "1234567")],
                                  "d string, n string")
    got = frame.select(checks.is_invoice_date("d").alias("d"),
                       checks.is_invoice_number("n").alias("n")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False)]


def test_settings(spark):
    rows = [("1", "boolean", "boolean"), ("1.5", "number", "number"), ("[1]", "json", "json"),
            ("{x", "json", "string"), ("maybe", "boolean", "string"), ("12d", "number", "string")]
    frame = spark.createDataFrame(rows, "value string, data_type string, inferred string")
    got = frame.select("inferred", text.inferred_type("value").alias("mine"),
                       text.typed_value()["error"].alias("e")).collect()
    assert all(r.inferred == r.mine for r in got)
    assert [r.e is None for r in got] == [True, True, True, False, False, False]


def test_display_text(spark):
    frame = spark.createDataFrame([(Decimal("1.2345"), True, "x" * 60)],
                                  "p decimal(10,4), b boolean, t string")
    row = frame.select(text.format_currency("p"), text.format_price("p"),
                       text.format_boolean("b"), text.truncate_text("t")).first()
    assert list(row) == ["$1.23", "$1.2345", "Yes", "x" * 47 + "..."]


def test_batch_rules(spark):
    frame = spark.createDataFrame([(1, "GOOD1"), (2, "bad!"), (3, "GOOD2"), (4, "x")],
                                  "row_no bigint, v string")
    checked = rules.check(frame, "v", checks.part_number_error)
    result = rules.batch_result(checked, "part_number").first()
    assert (result.success_count, result.error_count, result.success_rate, result.warning) == (
        2, 2, 50.0, None)
    stopped = rules.batch_result(rules.until_first_error(checked), "part_number", frame).first()
    assert (stopped.total_count, stopped.success_count, stopped.error_count) == (4, 1, 1)
    assert stopped.warning == "Low success rate: 25.0% of part_number items validated successfully"
    nothing = rules.batch_result(checked.filter("false"), "part_number").first()
    assert nothing.warning == "No part_number items provided for validation"
    assert rules.valid_items(checked).count() == rules.invalid_items(checked).count() == 2


def test_row_rules_name_missing_and_extra_fields(spark):
    frame = spark.createDataFrame([(1, "invalid!", "x")], "row_no bigint, part_number string, more string")
    row = rules.check_rows(frame, {"part_number": checks.part_number_error,
                                   "authorized_price": checks.price_error}).first()
    assert row.error.startswith("Row 1 validation failed: part_number: Part number can only")
    assert row.error.endswith("Missing required field: authorized_price")
    assert row.warning == "Unexpected fields ignored: more"


def test_digest_of_no_errors(spark):
    none = spark.createDataFrame([], "row_no bigint, field string, message string, severity string")
    assert [r.text for r in rules.error_digest(none).collect()] == ["No validation errors found."]


def test_digest_slots(spark):
    errors = spark.createDataFrame(
        [(i, "f", "m", s) for i, s in enumerate(
            ["ERROR"] * 4 + ["CRITICAL"] * 2 + ["WARNING"] * 3)],
        "row_no bigint, field string, message string, severity string")
    rows = rules.error_digest(errors, shown=5).collect()
    count = {b: sum(r.block == b and r.seq > 0 for r in rows) for b in (1, 2, 3)}
    assert count == {1: 2, 2: 3, 3: 1}
    assert any(r.text == "... and 4 more errors" for r in rows)
    texts = [r.text for r in sorted(rows, key=lambda r: (r.block, r.seq))]
    assert texts[:3] == ["Found 9 validation error(s):", "-" * 50, "CRITICAL ERRORS:"]
    at = texts.index("💡 SUGGESTIONS:")
    assert texts[at - 1] == "" and texts[at + 1] == "  • Check the input format and try again"


def test_first_word_ends_at_any_white_space(spark):
    rows = spark.createDataFrame([("ITEM\u00a0NOTE",), ("ITEM NOTE",), ("ITEMS NOTE",)], "line string")
    assert [r.h for r in rows.select(tl.is_heading_line("line").alias("h")).collect()] == [True, True, False]


INVOICE = """INVOICE NUMBER 12345678
INVOICE DATE 01/15/2025
CUSTOMER NUMBER 777
Ship To: ACME-NORTH
SUBTOTAL (ALL PAGES) 100.00
FREIGHT 10.00
TAX 5.00
TOTAL $115.00"""


def test_document_text_header_and_sections(spark):
    pages = spark.createDataFrame(
        [("a", 2, "TOTAL $115.00"), ("a", 1, INVOICE.rsplit("\n", 1)[0]), ("a", 3, ""), ("b", 1, None),
         ("c", 1, "short")], "doc_id string, page_no int, text string")
    texts = tl.document_text(pages)
    assert texts.filter("doc_id = 'a'").first().text == INVOICE + "\n"
    assert {r.doc_id for r in tl.readable_documents(texts).collect()} == {"a"}
    assert {r.doc_id: r.error for r in tl.unreadable_documents(pages, texts).collect()} == {
        "b": "No text could be extracted from PDF",
        "c": "Extracted text is too short (6 characters)"}
    head = tl.invoice_header(texts.filter("doc_id = 'a'")).first()
    assert (head.invoice_number, head.invoice_date, head.customer_number, head.customer_name) == (
        "12345678", "01/15/2025", "777", "ACME-NORTH\nSUBTOTAL")
    amounts = {r.section_type: float(r.amount) for r in tl.text_sections(texts).collect()}
    assert amounts == {"SUBTOTAL": 100.0, "FREIGHT": 10.0, "TAX": 5.0, "TOTAL": 115.0}
    assert {r.doc_id for r in tl.section_errors(texts, tl.text_sections(texts)).collect()} == {"c"}


@pytest.mark.parametrize("line,want", [
    ("12 Bill Langford GS0448NVOT SHIRT WORK LS 1XLR Rent 15 0.300 4.50",
     ("GS0448NVOT", "SHIRT WORK LS", "Rent", 0.3)),
    ("3 Anthony Carson PREP CHARGE 1 1.000 1.00", ("PREP_CHARGE", "PREP CHARGE", "Charge", 1.0)),
    ("MAT3X5 MAT SCRAPER X 2 4.250 8.50", ("MAT3X5", "MAT SCRAPER", "X", 4.25)),
    ("SUBTOTAL 12.00 1.000 1.00", None),
    ("ITEM only words", None),
    ("nothing to see 1.0", None),
])
def test_text_line_forms(spark, line, want):
    frame = spark.createDataFrame([("d", 1, line)], "doc_id string, line_no int, line string")
    got = [(r.part_number, r.description, r.item_type, float(r.rate))
           for r in tl.text_line_items(frame).collect()]
    assert got == ([] if want is None else [want])


def test_garment_shape_loses_no_garment(spark):
    """The short test before the garment pattern holds for every line that the pattern matches."""
    from ratecheck.operators import text_lines as tl
    lines = ["1 Ann GP1NAVY RED GEAR 40X28 Rent 2 0.300 0.60", "1 A  C   X X 1 0.30 0.30",
             "MAT12 RED GIZMO X 5 900.000 900.00", "MAT12 BIG RED GIZMO X 5 900.000 900.00",
             "7 Anthony Carson PREP CHARGE 9 9.40 9.40", "x1\u00a0Ann\u00a0B2 y 3X Ruin charge 1 2.00 2.00 z",
             "1 Ann B\n C D 2XL Loss  Charge 1 2.000 2.00", "note 9.0 small widget"]
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    got = frame.select(
        F.col("line").rlike("(?sU)" + tl.GARMENT_LINE).alias("full"),
        F.col("line").rlike("(?U)" + tl.GARMENT_SHAPE).alias("shape")).collect()
    assert any(r.full for r in got) and all(r.shape for r in got if r.full)
    assert not got[2].shape  # a plain line does not reach the garment pattern

"""Master table, files and statistics on the example rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ratecheck.functions.keys import composite_key
from ratecheck.operators import bulk, imports, master as mas, stats
from ratecheck.schemas import PARTS
from ratecheck.sinks import exports
from ratecheck.sources import csv_files, files, records

AS_OF = "2025-01-31 00:00:00"

IMPORT_CSV = '''part_number,authorized_price,description,category
PART001,10.50,Valid Part,Category1
PART002,,Missing Price,Category2
PART003,not_a_number,Invalid Price,Category3
PART004,15.00,"Valid Part with ""Quote""",Category4
PART005,-5.00,Negative Price,Category5
PART006,20.00,Another Valid Part,Category6
'''


@pytest.fixture(scope="module")
def master(spark):
    rows = [
        ("GP0171NAVY", "15.0000", "Navy Pants", None, "Clothing", True),
        ("GP0171KHAKI", "15.0000", "Khaki Pants", None, None, False),
        ("TOOL001", "15.9900", "HAMMER CLAW 16OZ", "TOOL", "Tools", True),
    ]
    frame = spark.createDataFrame(
        [(None, n, Decimal(p), d, t, c, "manual", None, None, None, a, None)
         for n, p, d, t, c, a in rows], PARTS)
    return frame.withColumn("composite_key", composite_key()).cache()


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_import_with_bad_rows(spark, master, tmp_path):
    rows = csv_files.read_parts_csv(spark, write(tmp_path, "parts.csv", IMPORT_CSV))
    outcomes = imports.import_outcomes(rows, master, False)
    got = {r.row_no: (r.outcome, r.error) for r in outcomes.collect()}
    assert got == {
        2: ("created", None), 3: ("error", "Missing authorized_price"),
        4: ("error", "Invalid price format"), 5: ("created", None),
        6: ("error", "Invalid price (must be positive)"), 7: ("created", None)}
    totals = imports.import_totals(outcomes).first()
    assert (totals.total_rows, totals.valid_rows_processed, totals.success) == (6, 3, True)
    merged = imports.import_upsert(master, rows, AS_OF)
    quoted = merged.filter("part_number = 'PART004'").first()
    assert quoted.description == 'Valid Part with "Quote"'
    assert quoted.authorized_price == Decimal("15.0000")
    assert quoted.source == "imported" and quoted.is_active


def test_merge_is_idempotent(spark, master, tmp_path):
    rows = csv_files.read_parts_csv(spark, write(tmp_path, "parts.csv", IMPORT_CSV))
    once = imports.import_upsert(master, rows, AS_OF, True)
    twice = imports.import_upsert(once, rows, AS_OF, True)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_cleaning_and_mapping(spark, tmp_path):
    path = write(tmp_path, "m.csv", "item_code,price,desc,category\n"
                 "gp0171navy,$15.50,  Navy Pants  ,\nx1,\"1,234.56\",Y,Z\n")
    mapping = csv_files.column_mapping(csv_files.read_text_csv(spark, write(
        tmp_path, "map.csv", "source_column,target_column\nitem_code,part_number\n"
        "price,authorized_price\n desc ,description\n,x\n")))
    assert mapping == {"item_code": "part_number", "price": "authorized_price",
                       "desc": "description"}
    rows = csv_files.read_parts_csv(spark, path, mapping).orderBy("row_no").collect()
    assert (rows[0].part_number, rows[0].authorized_price, rows[0].description,
            rows[0].category) == ("GP0171NAVY", Decimal("15.5000"), "Navy Pants", None)
    assert rows[1].authorized_price == Decimal("1234.5600")
    with pytest.raises(ValueError):
        csv_files.clean_import(spark.createDataFrame([("a",)], "part_number string"))


def test_row_numbers_follow_the_input(spark):
    frame = spark.range(0, 1000, 1, 7)
    got = csv_files.number_rows(frame, start=2).orderBy("id").collect()
    assert [r.row_no for r in got] == list(range(2, 1002))


def test_bulk_update_example(spark, master, tmp_path):
    text = ("part_number,price,description\nGP0171NAVY,15.50,Navy Work Pants\n"
            "GP0171KHAKI,16.00,\n,17.00,Invalid - empty part number\nMISSING,1.00,x\n"
            "GP0171NAVY,abc,Unreadable\n")
    rows = csv_files.number_rows(csv_files.read_text_csv(
        spark, write(tmp_path, "u.csv", text)), start=2)
    changes = csv_files.bulk_updates(rows, ("price", "description"))
    outcomes = bulk.update_outcomes(changes, master)
    totals = bulk.outcome_totals(outcomes).first()
    assert (totals.total_parts, totals.updated, totals.not_found, totals.errors) == (3, 2, 1, 0)
    after = {r.part_number: r for r in bulk.apply_updates(outcomes, master, AS_OF).collect()}
    assert after["GP0171NAVY"].authorized_price == Decimal("15.5000")
    assert after["GP0171NAVY"].description == "Navy Work Pants"
    assert after["GP0171KHAKI"].description == "Khaki Pants"
    assert after["GP0171NAVY"].composite_key == "|NAVY PANTS|GP0171NAVY"  # the key stays


def test_repeated_changes_win_per_field(spark, master):
    changes = spark.createDataFrame(
        [(1, "TOOL001", "1.00", Decimal("1.0000"), None), (2, "TOOL001", None, None, "New"),
         (3, "TOOL001", "2.00", Decimal("2.0000"), None)],
        "row_no bigint, part_number string, price_text string, authorized_price decimal(10,4), "
        "description string")
    after = bulk.apply_updates(bulk.update_outcomes(changes, master), master, AS_OF)
    row = after.filter("part_number = 'TOOL001'").first()
    assert (row.authorized_price, row.description) == (Decimal("2.0000"), "New")


def test_category_filter_ends_after_a_move(spark, master):
    changes = spark.createDataFrame(
        [(1, "TOOL001", "Tools"), (2, "TOOL001", "Other"), (3, "TOOL001", "Tools")],
        "row_no bigint, part_number string, category string")
    outcomes = bulk.update_outcomes(changes, master, "Tools")
    assert {r.row_no: r.outcome for r in outcomes.collect()} == {
        1: "updated", 2: "updated", 3: "filtered_out"}


def test_deletes_and_activations(spark, master):
    ids = spark.createDataFrame([(1, "TOOL001"), (2, "TOOL001"), (3, "NO")],
                                "row_no bigint, part_number string")
    hard = {r.row_no: r.outcome for r in bulk.delete_outcomes(ids, master, soft=False).collect()}
    assert hard == {1: "deleted", 2: "not_found", 3: "not_found"}
    soft = bulk.delete_outcomes(ids, master)
    assert {r.outcome for r in soft.filter("row_no < 3").collect()} == {"deleted"}
    after = bulk.apply_deletes(soft, master)
    assert after.filter("part_number = 'TOOL001'").first().is_active is False
    khaki = spark.createDataFrame([(1, "GP0171KHAKI"), (2, "GP0171KHAKI")],
                                  "row_no bigint, part_number string")
    on = bulk.activate_outcomes(khaki, master)
    assert {r.row_no: r.outcome for r in on.collect()} == {1: "activated", 2: "already_active"}
    done = bulk.apply_activations(on, master, AS_OF)
    assert done.filter("NOT is_active").count() == 0


def test_lookup_prefers_the_key(spark, master):
    extra = master.limit(1).withColumns({
        "part_number": F.lit("TOOL|HAMMER CLAW 16OZ|TOOL001"), "composite_key": F.lit("A|B|C")})
    both = master.unionByName(extra)
    ask = spark.createDataFrame([("TOOL|HAMMER CLAW 16OZ|TOOL001",), ("TOOL001",), ("NO",)], "q string")
    got = {r.q: r.target_key for r in mas.resolve(ask, both, "q").collect()}
    assert got["TOOL|HAMMER CLAW 16OZ|TOOL001"] == "TOOL|HAMMER CLAW 16OZ|TOOL001"
    assert got["TOOL001"] == "TOOL|HAMMER CLAW 16OZ|TOOL001" and got["NO"] is None


def test_update_rekeys_on_request(spark, master):
    change = spark.createDataFrame([("|NAVY PANTS|GP0171NAVY", "Work  pants")],
                                   "target_key string, description string")
    keys = [mas.update_parts(master, change, AS_OF, rekey).filter(
        "part_number = 'GP0171NAVY'").first().composite_key for rekey in (True, False)]
    assert keys == ["|WORK PANTS|GP0171NAVY", "|NAVY PANTS|GP0171NAVY"]


@pytest.mark.parametrize("prices", [[1, 2, 3, 4], [1, 2, 3], [7], [5, 5, 5, 1, 9]])
def test_upper_median(spark, prices):
    frame = spark.createDataFrame([(Decimal(p),) for p in prices], "authorized_price decimal(10,4)")
    assert stats.upper_median(frame).first()[0] == sorted(prices)[len(prices) // 2]


def test_upper_median_of_many_values(spark):
    frame = spark.range(5001).selectExpr(
        "CAST((id * 7919 % 5003) * 123.4567 AS DECIMAL(10,4)) AS authorized_price")
    values = sorted(r[0] for r in frame.collect())
    assert stats.upper_median(frame, parts=7).first()[0] == values[len(values) // 2]


def test_statistics_keep_their_own_category_rules(master):
    assert [r.category for r in stats.category_breakdown(master).collect()] == ["Clothing", "Tools"]
    assert {r.category for r in stats.active_categories(master).collect()} == {"Clothing", "Tools"}
    empty = stats.display_statistics(master.filter("false")).first()
    assert (empty.total_parts, empty.average_price, empty.top_category) == (0, 0, "None")


def test_missing_columns(spark, master):
    found = stats.missing_columns({"parts": master}, {"parts": ["notes", "colour"], "log": ["id"]})
    assert sorted(map(tuple, found.collect())) == [("log", "id"), ("parts", "colour")]


def test_files_and_folders(spark, tmp_path):
    for name in ("a/1.pdf", "a/2.PDF", "b/3.pdf", "b/skip.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"%PDF")
    found = files.list_files(spark, str(tmp_path))
    assert found.count() == 3
    folders = {r.folder.split("/")[-1]: r["count"] for r in files.invoice_folders(found).collect()}
    assert folders == {"a": 2, "b": 1}
    assert files.list_files(spark, str(tmp_path / "a"), recursive=False).count() == 2


def test_exports_write_what_they_show(spark, master, tmp_path):
    exports.write_result(exports.parts_export(master), str(tmp_path / "csv"), "csv")
    back = spark.read.csv(str(tmp_path / "csv"), header=True).orderBy("part_number").collect()
    assert [r.authorized_price for r in back] == ["15.00", "15.00", "15.99"]
    assert back[0].is_active == "false"
    exports.write_formats(master, str(tmp_path / "all"), ("json", "txt"))
    assert spark.read.json(str(tmp_path / "all/json")).count() == 3
    with pytest.raises(ValueError):
        exports.write_result(master, str(tmp_path / "x"), "xml")


def test_dated_reports_land_in_their_folder(spark, tmp_path):
    frame = spark.createDataFrame([("10000001", 1), (None, 2), ("UNKNOWN", 3)],
                                  "invoice_number string, n int")
    exports.write_dated(frame, "2025-01-31", str(tmp_path / "out"))
    folder = tmp_path / "out" / "run_date=20250131"
    assert sorted(x.name for x in folder.iterdir()) == ["name=10000001", "name=report"]
    assert all(len(list(x.glob("part-*"))) == 1 for x in folder.iterdir())
    names = {r["n"]: r["name"] for r in exports.dated_reports(frame, "2025-01-31").collect()}
    assert names == {1: "10000001", 2: "report", 3: "report"}


def test_nameless_reports_spread_over_files(spark, tmp_path):
    # Small outputs are put together again by their size; here the dealing itself is looked at.
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    reports = spark.range(10_000).selectExpr(
        "concat('doc-', id) AS doc_id", "CAST(NULL AS STRING) AS invoice_number",
        "explode(sequence(1, 2)) AS line")
    spark.conf.set(coalesce, "false")
    try:
        exports.write_dated(reports, "2025-01-31", str(tmp_path / "out"))
    finally:
        spark.conf.set(coalesce, before)
    back = spark.read.json(str(tmp_path / "out")).withColumn("file", F.input_file_name())
    assert back.count() == 20_000
    per_file = back.groupBy("file").count().collect()
    assert len(per_file) > 1 and max(r["count"] for r in per_file) < 10_000
    assert back.groupBy("doc_id").agg(F.count_distinct("file").alias("n")).filter("n > 1").isEmpty()


def test_typed_round_trip(master):
    back = records.typed_rows(records.as_text(master), PARTS)
    assert sorted(map(str, back.collect())) == sorted(map(str, master.select(back.columns).collect()))


def test_extraction_records_with_missing_keys(spark, tmp_path):
    path = write(tmp_path, "one.json", '''{"invoice_metadata": {"invoice_number": "10000001"},
      "format_sections": [{"section_type": "TOTAL", "amount": 2.30}],
      "parts": [{"database_fields": {"part_number": "GS0448", "authorized_price": 1.15,
                 "item_type": "Rent"}, "lineitem_fields": {"line_number": 1, "quantity": 2}}]}''')
    records_frame = records.read_extractions(spark, path)
    row = records.flat_lines(records_frame).first()
    assert (row.invoice_date, row.description, row.source, row.quantity) == ("", "", "extracted", 2)
    assert row.rate == Decimal("1.1500") and row.total is None
    assert records.flat_sections(records_frame).first().amount == Decimal("2.3000")


def test_requests_by_key_and_by_number_are_one_part(spark, master):
    part = master.filter("part_number = 'TOOL001'").first()
    requests = spark.createDataFrame(
        [(1, part.composite_key), (2, "TOOL001"), (3, "TOOL001"), (4, "NOPE")],
        "row_no bigint, part_number string")
    deleted = bulk.delete_outcomes(requests, master, soft=False).orderBy("row_no").collect()
    assert [r.outcome for r in deleted] == ["deleted", "not_found", "not_found", "not_found"]
    idle = master.withColumn("is_active", F.lit(False))
    active = bulk.activate_outcomes(requests, idle).orderBy("row_no").collect()
    assert [r.outcome for r in active] == ["activated", "already_active", "already_active",
                                           "not_found"]

"""Fixed schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(18, 4)
MONEY = T.DecimalType(18, 4)
# Price times quantity.
AMOUNT = T.DecimalType(28, 4)

PARTS = T.StructType([
    T.StructField("composite_key", T.StringType()),
    T.StructField("part_number", T.StringType()),
    T.StructField("authorized_price", PRICE),
    T.StructField("description", T.StringType()),
    T.StructField("item_type", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("first_seen_invoice", T.StringType()),
    T.StructField("created_date", T.TimestampType()),
    T.StructField("last_updated", T.TimestampType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("notes", T.StringType()),
])

DISCOVERY_LOG = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("part_number", T.StringType()),
    T.StructField("invoice_number", T.StringType()),
    T.StructField("invoice_date", T.StringType()),
    T.StructField("discovered_price", PRICE),
    T.StructField("authorized_price", PRICE),
    T.StructField("action_taken", T.StringType()),
    T.StructField("user_decision", T.StringType()),
    T.StructField("discovery_date", T.TimestampType()),
    T.StructField("processing_session_id", T.StringType()),
    T.StructField("notes", T.StringType()),
])

INVOICE_LINES = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("row_idx", T.LongType()),
    T.StructField("line_id", T.StringType()),
    T.StructField("line_number", T.StringType()),
    T.StructField("part_number", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("item_type", T.StringType()),
    T.StructField("rate", MONEY),
    T.StructField("quantity", T.LongType()),
    T.StructField("total", AMOUNT),
    T.StructField("raw_text", T.StringType()),
])

SECTION = T.StructType([
    T.StructField("section_type", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("raw_text", T.StringType()),
    T.StructField("line_number", T.StringType()),
])

DATABASE_FIELDS = T.StructType([
    T.StructField("part_number", T.StringType()),
    T.StructField("authorized_price", MONEY),
    T.StructField("description", T.StringType()),
    T.StructField("item_type", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("first_seen_invoice", T.StringType()),
])

LINEITEM_FIELDS = T.StructType([
    T.StructField("line_number", T.StringType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("total", AMOUNT),
    T.StructField("raw_text", T.StringType()),
])

EXTRACTION = T.StructType([
    T.StructField("invoice_metadata", T.StructType([
        T.StructField("invoice_number", T.StringType()),
        T.StructField("invoice_date", T.StringType()),
        T.StructField("customer_number", T.StringType()),
        T.StructField("customer_name", T.StringType()),
        T.StructField("total_line_items", T.IntegerType()),
        T.StructField("first_line", T.IntegerType()),
        T.StructField("pdf_path", T.StringType()),
        T.StructField("extraction_timestamp", T.StringType()),
    ])),
    T.StructField("format_sections", T.ArrayType(SECTION)),
    T.StructField("parts", T.ArrayType(T.StructType([
        T.StructField("database_fields", DATABASE_FIELDS),
        T.StructField("lineitem_fields", LINEITEM_FIELDS),
    ]))),
])

INVOICE_RECORD = T.StructType([
    T.StructField("invoice_number", T.StringType()),
    T.StructField("invoice_date", T.StringType()),
    T.StructField("customer_number", T.StringType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("line_items", T.ArrayType(T.StructType([
        T.StructField("item_code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("item_type", T.StringType()),
        T.StructField("rate", MONEY),
        T.StructField("quantity", T.LongType()),
        T.StructField("total", AMOUNT),
        T.StructField("line_number", T.StringType()),
        T.StructField("raw_text", T.StringType()),
    ]))),
    T.StructField("format_sections", T.ArrayType(SECTION)),
    T.StructField("pdf_path", T.StringType()),
    T.StructField("page_count", T.IntegerType()),
    T.StructField("processing_notes", T.ArrayType(T.StringType())),
])

LEGAL_SOURCES = ("manual", "discovered", "imported")
LEGAL_ACTIONS = ("discovered", "added", "updated", "skipped", "price_mismatch")
SECTION_ORDER = ("SUBTOTAL", "FREIGHT", "TAX", "TOTAL")

"""Catalog: document text, text lines, line records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratecheck.operators import lines as li
from ratecheck.operators import text_lines as tl
from ratecheck.plans.catalog_audit import AUDIT_VIEWS, doubles
from ratecheck.plans.driver_views import DriverViews
from ratecheck.plans.oracle_views import with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# The invoice pages as text expressions; the two dialects share everything but the names
# of three functions, so one template serves both.
HEADER_TEXT = """concat(
    CASE o_orderstatus WHEN 'O' THEN concat('INVOICE',
         CASE WHEN o_orderpriority = '3-MEDIUM' THEN {nb} ELSE ' ' END, 'NUMBER ') WHEN 'F' THEN 'Invoice # '
         ELSE 'invoice number: ' END, 10000000 + o_orderkey, {nl},
    CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'no date'
         WHEN o_orderpriority = '1-URGENT' THEN concat('Date ', {date})
         WHEN o_orderpriority = '2-HIGH' THEN concat('Invoice Date: ', {date})
         ELSE concat('INVOICE DATE  ', {date}) END, {nl},
    CASE WHEN o_orderstatus = 'F' THEN 'Account Number ' ELSE 'Customer Number: ' END,
    o_custkey, {nl},
    CASE WHEN o_orderstatus = 'P' THEN 'SHIP TO: NORTH DEPOT'
         ELSE concat('Ship To: NORTH-WEST DEPOT', {nl}, '12 Main St') END,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN ''
         ELSE concat({nl}, 'Please pay the amount below within thirty days of receipt') END)"""
AMOUNT_TEXT = """concat(
    CASE WHEN o_orderstatus = 'P' THEN 'Sub Total: $' WHEN o_orderstatus = 'F' THEN 'SUBTOTAL '
         ELSE 'SUBTOTAL (ALL PAGES)  ' END, {amount}, {nl},
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'Shipping $12.50' ELSE 'FREIGHT 12.50' END, {nl},
    CASE WHEN o_orderpriority = '5-LOW' THEN '' WHEN o_orderstatus = 'F' THEN 'Sales Tax: $7.25'
         ELSE concat('TAX', {nb}, '7.25') END, {nl}, 'TOTAL $', {total})"""
SHORT = "o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P'"
LAST_TEXT = "CASE WHEN o_orderstatus = 'F' THEN '' WHEN o_orderstatus = 'O' THEN 'Thank you' END"
LINE_TEXT = """CASE
    WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN concat(l_linenumber,
        ' Anthony Carson GP', p_partkey, 'NAVY ', upper(p_name), ' 40X28 ',
        CASE WHEN l_tax > 0.04 THEN 'Rent' ELSE 'Ruin charge' END,
        CASE WHEN l_tax > 0.06 THEN {nb} ELSE ' ' END, {qty}, ' ', {rate3}, ' ',
        {rate2})
    WHEN l_returnflag = 'R' THEN concat(l_linenumber, ' Anthony Carson ',
        CASE WHEN l_tax > 0.04 THEN 'PREP CHARGE' ELSE 'NAME EMBL CHARGE' END, ' ', {qty}, ' ',
        {rate2}, ' ', {rate2})
    WHEN l_returnflag = 'N' THEN concat('MAT', p_partkey, ' ', upper(p_name), ' X ', {qty}, ' ',
        {rate3}, ' ', {rate2})
    WHEN l_linestatus = 'O' THEN concat('WEARER# WEARER NAME ', p_name)
    WHEN l_tax > 0.04 THEN concat('Item ', p_name)
    ELSE concat('note ', l_quantity, ' ', p_name) END"""

SPARK_NAMES = {
    "nl": "'\\n'", "nb": "'\\u00a0'", "date": "date_format(o_orderdate, 'MM/dd/yyyy')",
    "amount": "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)",
    "total": "CAST(CAST(o_totalprice AS DECIMAL(18,2)) + 19.75 AS STRING)",
    "qty": "CAST(l_quantity AS INT)",
    "rate3": "CAST(CAST(p_retailprice AS DECIMAL(18,3)) AS STRING)",
    "rate2": "CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING)",
}
DUCK_NAMES = {
    **{k: s.replace("STRING", "VARCHAR") for k, s in SPARK_NAMES.items()},
    "nl": "chr(10)", "nb": "chr(160)", "date": "strftime(o_orderdate, '%m/%d/%Y')",
}


def pages(v: DriverViews):
    """Three text pages per order; the last is blank or null for some."""
    rows = v.table("orders").selectExpr(
        "concat('doc-', o_orderkey) AS doc_id",
        f"""inline(array(
            named_struct('page_no', 1, 'text', {HEADER_TEXT.format(**SPARK_NAMES)}),
            named_struct('page_no', 2, 'text', CASE WHEN {SHORT} THEN ''
                         ELSE {AMOUNT_TEXT.format(**SPARK_NAMES)} END),
            named_struct('page_no', 3, 'text', {LAST_TEXT})))""")
    return rows


def order_lines(v: DriverViews):
    """One text line per order line, in the supplier's written forms."""
    priced = v.table("lineitem").join(v.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return priced.selectExpr(
        "concat('doc-', l_orderkey) AS doc_id", "l_linenumber AS line_no",
        f"{LINE_TEXT.format(**SPARK_NAMES)} AS line")


# The three written forms of a line item.
GARMENT = (r"(\d+)\s+([A-Z][A-Za-z\s\-\.]+?)\s+([A-Z0-9]+(?:NAVY|NVOT|CHAR|LGOT|SCGR|BLAK|WHIT|SLVN"
           r"|GREY)?)\s+(.+?)\s+([A-Z0-9X]+|X)\s+(Rent|Loss\s+Charge|Ruin\s+charge|PREP\s+CHARGE|X)"
           r"\s+(\d+)\s+(\d+\.\d{2,3})\s+(\d+\.\d{2})")
CHARGE = (r"(\d+)\s+([A-Z][A-Za-z\s\-\.]+?)\s+(NAME\s+EMBL\s+CHARGE|PREP\s+CHARGE)\s+(\d+)"
          r"\s+(\d+\.\d{2,3})\s+(\d+\.\d{2})")
PLAIN = (r"^([A-Z0-9]+(?:NAVY|NVOT|CHAR|LGOT|SCGR|BLAK|WHIT|SLVN|GREY)?)\s+(.+?)\s+(Rent|X)\s+(\d+)"
         r"\s+(\d+\.\d{2,3})\s+(\d+\.\d{2})$")


def groups(pattern: str, *wanted: int) -> str:
    """A SQL list with the wanted groups of a pattern at their numbers."""
    return "[" + ", ".join(f"regexp_extract(line, '{pattern}', {i})" if i in wanted else "NULL"
                           for i in range(1, max(wanted) + 1)) + "]"


TEXT_VIEWS = {
    **AUDIT_VIEWS,
    "v_pages": f"""
        SELECT 'doc-' || o_orderkey AS doc_id, g AS page_no,
               CASE g WHEN 1 THEN {HEADER_TEXT.format(**DUCK_NAMES)}
                      WHEN 2 THEN CASE WHEN {SHORT} THEN ''
                                       ELSE {AMOUNT_TEXT.format(**DUCK_NAMES)} END
                      ELSE {LAST_TEXT} END AS text
        FROM orders, (VALUES (1), (2), (3)) s(g)""",
    "v_texts": """
        SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no) || chr(10) AS text
        FROM v_pages WHERE text <> '' GROUP BY doc_id""",
    "v_header": """
        SELECT doc_id,
               coalesce(nullif(regexp_extract(text, '(?i)INVOICE\\s+NUMBER\\s+(\\d+)', 1), ''),
                        nullif(regexp_extract(text, '(?i)INVOICE\\s*#\\s*(\\d+)', 1), ''),
                        nullif(regexp_extract(text, '(?i)Invoice\\s+Number:\\s*(\\d+)', 1), ''))
                 AS invoice_number,
               coalesce(nullif(regexp_extract(text,
                          '(?i)INVOICE\\s+DATE\\s+(\\d{2}/\\d{2}/\\d{4})', 1), ''),
                        nullif(regexp_extract(text,
                          '(?i)Invoice\\s+Date:\\s*(\\d{2}/\\d{2}/\\d{4})', 1), ''),
                        nullif(regexp_extract(text,
                          '(?i)DATE\\s+(\\d{2}/\\d{2}/\\d{4})', 1), '')) AS invoice_date,
               coalesce(nullif(regexp_extract(text, '(?i)CUSTOMER\\s+NUMBER\\s+(\\d+)', 1), ''),
                        nullif(regexp_extract(text, '(?i)Customer\\s+Number:\\s*(\\d+)', 1), ''),
                        nullif(regexp_extract(text, '(?i)ACCOUNT\\s+NUMBER\\s+(\\d+)', 1), ''))
                 AS customer_number,
               nullif(regexp_replace(regexp_extract(text, 'Ship\\s+To:\\s*([A-Z\\s\\-]+)', 1),
                                     '^\\s+|\\s+$', '', 'g'), '') AS customer_name
        FROM (SELECT doc_id, replace(text, chr(160), ' ') AS text FROM v_texts)""",
    "v_section_text": """
        SELECT doc_id, section_type, section_pos, CAST(a AS DECIMAL(18,4)) AS amount FROM (
          SELECT doc_id, s.t AS section_type, s.p AS section_pos, CASE s.t
            WHEN 'SUBTOTAL' THEN coalesce(
              nullif(regexp_extract(text, '(?i)SUBTOTAL\\s*\\(ALL\\s+PAGES\\)\\s+(\\d+\\.\\d{2})', 1), ''),
              nullif(regexp_extract(text, '(?i)SUBTOTAL\\s+(\\d+\\.\\d{2})', 1), ''),
              nullif(regexp_extract(text, '(?i)Sub\\s*Total\\s*:?\\s*\\$?(\\d+\\.\\d{2})', 1), ''))
            WHEN 'FREIGHT' THEN coalesce(
              nullif(regexp_extract(text, '(?i)FREIGHT\\s+(\\d+\\.\\d{2})', 1), ''),
              nullif(regexp_extract(text, '(?i)Freight\\s*:?\\s*\\$?(\\d+\\.\\d{2})', 1), ''),
              nullif(regexp_extract(text, '(?i)SHIPPING\\s*:?\\s*\\$?(\\d+\\.\\d{2})', 1), ''))
            WHEN 'TAX' THEN coalesce(
              nullif(regexp_extract(text, '(?i)TAX\\s+(\\d+\\.\\d{2})', 1), ''),
              nullif(regexp_extract(text, '(?i)Tax\\s*:?\\s*\\$?(\\d+\\.\\d{2})', 1), ''))
            ELSE coalesce(
              nullif(regexp_extract(text, '(?i)TOTAL\\s+\\$(\\d+\\.\\d{2})', 1), ''),
              nullif(regexp_extract(text, '(?i)Total\\s*:?\\s*\\$?(\\d+\\.\\d{2})', 1), ''))
            END AS a
          FROM (SELECT doc_id, replace(text, chr(160), ' ') AS text FROM v_texts),
               (VALUES ('SUBTOTAL', 1), ('FREIGHT', 2), ('TAX', 3), ('TOTAL', 4)) s(t, p))
        WHERE a IS NOT NULL""",
    "v_text_lines": f"""
        SELECT 'doc-' || l_orderkey AS doc_id, l_linenumber AS line_no,
               {LINE_TEXT.format(**DUCK_NAMES)} AS line
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "v_items": r"""
        SELECT * FROM (
          SELECT doc_id, line_no, raw, CASE
            WHEN regexp_matches(upper(line), 'WEARER#|WEARER NAME|ITEM CODE|ITEM DESCRIPTION|SIZE|TYPE|BILL QTY|RATE|TOTAL|SUBTOTAL|FREIGHT|TAX |THANK YOU|VISIT US|BILLING INQUIRIES|CUSTOMER SERVICE|ACCOUNT NUMBER|INVOICE NUMBER|INVOICE DATE|PAGE |SHIP TO|MARKET CENTER|ROUTE NUMBER')
              OR (regexp_matches(upper(line), '^(WEARER|ITEM|DESCRIPTION|SIZE|TYPE)(\s|$)')
                  AND NOT regexp_matches(line, '[0-9]')) THEN NULL
            WHEN g[1] <> '' THEN {'code': g[3], 'description': g[4], 'kind': g[6], 'rate': g[8]}
            WHEN c[1] <> '' THEN {'code': replace(c[3], ' ', '_'), 'description': c[3],
                                  'kind': 'Charge', 'rate': c[5]}
            WHEN p[1] <> '' THEN {'code': p[1], 'description': p[2], 'kind': p[3], 'rate': p[5]}
            END AS item
          FROM (SELECT *,
                  {garment} AS g, {charge} AS c, {plain} AS p
                FROM (SELECT doc_id, line_no, line AS raw, replace(line, chr(160), ' ') AS line
                      FROM v_text_lines)))
        WHERE item IS NOT NULL""".replace("{garment}", groups(GARMENT, 1, 3, 4, 6, 8)).replace(
        "{charge}", groups(CHARGE, 1, 3, 5)).replace("{plain}", groups(PLAIN, 1, 2, 3, 5)),
}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = lambda spark, folder: fn(DriverViews(spark, folder))
        if sql is not None:
            ORACLE[name] = with_views(sql, TEXT_VIEWS)
        return fn
    return keep


@register("b1_document_text", """
    SELECT doc_id, text FROM v_texts
    WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 100""")
def _(v):
    return tl.readable_documents(tl.document_text(pages(v)))


@register("b1_conversation_text", """
    SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn, text) || chr(10) AS text
    FROM conversations WHERE text <> '' GROUP BY conv_id""")
def _(v):
    turns = v.table("conversations").selectExpr("conv_id AS doc_id", "turn AS page_no", "text")
    return tl.document_text(turns)


@register("b1_unreadable_documents", """
    SELECT d.doc_id, CASE WHEN n = 0 THEN 'No text could be extracted from PDF'
             ELSE 'Extracted text is too short (' || length(text) || ' characters)' END AS error
    FROM (SELECT p.doc_id, t.text, length(regexp_replace(coalesce(t.text, ''),
                   '^\\s+|\\s+$', '', 'g')) AS n
          FROM (SELECT DISTINCT doc_id FROM v_pages) p LEFT JOIN v_texts t
            ON p.doc_id = t.doc_id) d WHERE n < 100""")
def _(v):
    p = pages(v)
    return tl.unreadable_documents(p, tl.document_text(p))


@register("b2_first_match", "SELECT doc_id, invoice_number FROM v_header")
def _(v):
    return tl.document_text(pages(v)).select(
        "doc_id", tl.first_match("text", tl.INVOICE_NUMBER).alias("invoice_number"))


@register("b3_invoice_header", """
    SELECT *, concat_ws(', ', CASE WHEN invoice_number IS NULL THEN 'invoice_number' END,
                        CASE WHEN invoice_date IS NULL THEN 'invoice_date' END) AS missing_fields
    FROM v_header""")
def _(v):
    return tl.invoice_header(tl.document_text(pages(v))).withColumn(
        "missing_fields", F.array_join("missing_fields", ", "))


@register("b3_header_errors", """
    SELECT doc_id, 'Required metadata fields missing: ' || concat_ws(', ',
             CASE WHEN invoice_number IS NULL THEN 'invoice_number' END,
             CASE WHEN invoice_date IS NULL THEN 'invoice_date' END) AS error
    FROM v_header WHERE invoice_number IS NULL OR invoice_date IS NULL""")
def _(v):
    return tl.header_errors(tl.invoice_header(tl.document_text(pages(v))))


@register("b4_section_amounts", """
    SELECT doc_id, section_type, section_pos, CAST(amount AS DOUBLE) AS amount
    FROM v_section_text""")
def _(v):
    return doubles(tl.text_sections(tl.document_text(pages(v))), "amount")


@register("b4_section_errors", """
    SELECT t.doc_id, 'Expected 4 format sections, found ' || coalesce(n, 0) AS error
    FROM v_texts t LEFT JOIN (SELECT doc_id, count(*) AS n FROM v_section_text GROUP BY 1) s
      ON t.doc_id = s.doc_id WHERE coalesce(n, 0) <> 4""")
def _(v):
    texts = tl.document_text(pages(v))
    return tl.section_errors(texts, tl.text_sections(texts))


HEADING_SQL = """
    regexp_matches(upper(line), 'WEARER#|WEARER NAME|ITEM CODE|ITEM DESCRIPTION|SIZE|TYPE|BILL QTY'
      || '|RATE|TOTAL|SUBTOTAL|FREIGHT|TAX |THANK YOU|VISIT US|BILLING INQUIRIES|CUSTOMER SERVICE'
      || '|ACCOUNT NUMBER|INVOICE NUMBER|INVOICE DATE|PAGE |SHIP TO|MARKET CENTER|ROUTE NUMBER')
    OR (regexp_matches(upper(line), '^(WEARER|ITEM|DESCRIPTION|SIZE|TYPE)(\\s|$)')
        AND NOT regexp_matches(line, '[0-9]'))"""


@register("b5_heading_lines", f"""
    SELECT doc_id, line_no, {HEADING_SQL} AS heading FROM v_text_lines""")
def _(v):
    return order_lines(v).select("doc_id", "line_no", tl.is_heading_line("line").alias("heading"))


@register("b5_document_lines", f"""
    SELECT doc_id, CAST(i AS INTEGER) AS line_no, {HEADING_SQL} AS heading
    FROM (SELECT doc_id, i, regexp_replace(l[i], '^\\s+|\\s+$', '', 'g') AS line
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
               unnest(range(1, len(l) + 1)) u(i))
    WHERE line <> ''""")
def _(v):
    lines = tl.split_lines(v.table("documents").select("doc_id", "text"))
    return lines.select("doc_id", "line_no", tl.is_heading_line("line").alias("heading"))


@register("b6_text_line_items", """
    SELECT doc_id, CAST(line_no AS VARCHAR) AS line_number, item.code AS part_number,
           item.description AS description, item.kind AS item_type,
           CAST(CAST(item.rate AS DECIMAL(18,4)) AS DOUBLE) AS rate, 1 AS quantity,
           CAST(CAST(item.rate AS DECIMAL(18,4)) AS DOUBLE) AS total, raw AS raw_text
    FROM v_items""")
def _(v):
    return doubles(tl.text_line_items(order_lines(v)).drop("row_idx", "line_id"), "rate", "total")


@register("b6_documents_without_items", """
    SELECT DISTINCT doc_id, 'No valid line items found in invoice' AS error
    FROM v_text_lines WHERE doc_id NOT IN (SELECT doc_id FROM v_items)""")
def _(v):
    lines = order_lines(v)
    return tl.documents_without_items(lines, tl.text_line_items(lines))


def loose_lines(v):
    """Line fields as text, with quantities and totals that need normalizing."""
    return v.table("lineitem").selectExpr(
        "concat('doc-', l_orderkey) AS doc_id",
        "concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS line_id",
        "CASE WHEN l_quantity = 1 THEN 'one' WHEN l_quantity = 2 THEN NULL "
        "ELSE concat(CAST(l_quantity AS INT), '.7') END AS quantity",
        "CASE WHEN l_quantity = 3 THEN 'n/a' "
        "ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) END AS rate",
        "CASE WHEN l_tax > 0.04 THEN NULL WHEN l_tax = 0.03 THEN 'x' ELSE '10.5' END AS total")


@register("b19_line_normalization", """
    SELECT doc_id, line_id, quantity, CAST(rate AS DOUBLE) AS rate,
           CAST(coalesce(total, CAST(CAST(rate AS DECIMAL(14,4)) * quantity AS DECIMAL(18,4)))
                AS DOUBLE) AS total
    FROM (SELECT 'doc-' || l_orderkey AS doc_id,
                 concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS line_id,
                 CASE WHEN l_quantity <= 2 THEN 1 ELSE CAST(l_quantity AS INTEGER) END AS quantity,
                 CASE WHEN l_quantity = 3 THEN NULL
                      ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(18,4)) END AS rate,
                 CASE WHEN l_tax > 0.04 OR l_tax = 0.03 THEN NULL
                      ELSE CAST(10.5 AS DECIMAL(18,4)) END AS total
          FROM lineitem)""")
def _(v):
    return doubles(li.normalize_lines(loose_lines(v)), "rate", "total")


@register("b20_valid_lines", """
    SELECT doc_id, line_id FROM v_lines
    WHERE coalesce(quantity, 0) <> 0 AND rate IS NOT NULL
      AND trim(coalesce(description, '')) <> ''""")
def _(v):
    return li.valid_lines(v.lines()).select("doc_id", "line_id")


@register("b21_candidate_parts", """
    SELECT l.doc_id, l.line_id, l.part_number, CAST(l.rate AS DOUBLE) AS authorized_price,
           l.description, l.item_type, i.invoice_number AS first_seen_invoice
    FROM v_lines l LEFT JOIN v_invoices i ON l.doc_id = i.doc_id""")
def _(v):
    return doubles(li.candidate_parts(v.lines(), v.invoices()), "authorized_price")


@register("b22_rate_and_quantity", """
    SELECT doc_id, line_id,
           CASE WHEN len(f) >= 3 AND regexp_full_match(replace(replace(trim(f[-2]), '.', ''),
                     '-', ''), '[0-9]+') THEN try_cast(trim(f[-2]) AS DOUBLE) END AS rate,
           CASE WHEN len(f) >= 3 AND regexp_full_match(trim(f[-3]), '[0-9]+')
                THEN CAST(trim(f[-3]) AS INTEGER) END AS quantity
    FROM (SELECT doc_id, line_id, string_split(raw_text, '|') AS f FROM v_lines)""")
def _(v):
    return v.lines().select("doc_id", "line_id", li.rate_and_quantity("raw_text").alias("r")).select(
        "doc_id", "line_id", "r.rate", "r.quantity")

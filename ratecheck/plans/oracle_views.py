"""The views of ``driver_views`` in DuckDB SQL, as named common table expressions."""

from __future__ import annotations

import re

NORMAL = "coalesce(trim(regexp_replace(upper({0}), '\\s+', ' ', 'g')), '')"


def key_sql(item_type="item_type", description="description", part_number="part_number") -> str:
    return " || '|' || ".join(NORMAL.format(c) for c in (item_type, description, part_number))


VIEWS: dict[str, str] = {
    "v_parts_all": f"""
        SELECT row_no, part_number, authorized_price, description, item_type, category, source,
               first_seen_invoice, created_date, last_updated, is_active, notes,
               {key_sql()} AS composite_key
        FROM (SELECT p_partkey AS row_no, CASE WHEN p_brand = 'Brand#25' THEN 'U-' || p_partkey
                          ELSE 'P-' || (p_partkey // 2) END AS part_number,
                     CAST(p_retailprice AS DECIMAL(18,4)) AS authorized_price,
                     p_name AS description, p_type AS item_type,
                     CASE WHEN p_size <= 8 THEN NULL WHEN p_size <= 12 THEN ''
                          ELSE 'Category ' || p_brand END AS category,
                     CASE WHEN p_size <= 16 THEN 'manual' WHEN p_size <= 33 THEN 'discovered'
                          ELSE 'imported' END AS source,
                     CASE WHEN p_size BETWEEN 17 AND 33 THEN 'INV' || p_partkey END
                       AS first_seen_invoice,
                     TIMESTAMP '2024-01-01' + to_days(p_size) AS created_date,
                     TIMESTAMP '2024-01-01' + to_days(p_size + 1) AS last_updated,
                     p_size < 44 AS is_active, p_brand AS notes
              FROM part)""",
    "v_master": """
        SELECT * EXCLUDE (row_no, rn) FROM (
          SELECT *, row_number() OVER (PARTITION BY composite_key ORDER BY row_no) AS rn
          FROM v_parts_all WHERE notes <> 'Brand#25') WHERE rn = 1""",
    "v_invoices": """
        SELECT 'doc-' || o_orderkey AS doc_id, o_orderpriority AS folder,
               '/invoices/' || o_orderpriority || '/doc-' || o_orderkey || '.pdf' AS path,
               CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
                    THEN 'X' || o_orderkey ELSE CAST(10000000 + o_orderkey AS VARCHAR) END
                 AS invoice_number,
               CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL
                    ELSE strftime(o_orderdate, '%m/%d/%Y') END AS invoice_date,
               CAST(o_custkey AS VARCHAR) AS customer_number
        FROM orders""",
    "v_lines": """
        SELECT doc_id, row_idx, line_id, line_number, part_number, description, item_type,
               rate, quantity,
               CASE WHEN l_tax = 0.07 THEN NULL WHEN l_tax = 0.06 THEN CAST(0 AS DECIMAL(18,4))
                    ELSE CAST(CAST(rate AS DECIMAL(14,4)) * quantity AS DECIMAL(18,4)) END AS total,
               concat_ws(' | ', line_number, 'A Wearer', part_number, trim(description), '',
                         item_type, quantity, CAST(rate AS VARCHAR), '0.00') AS raw_text
        FROM (SELECT 'doc-' || l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS row_idx,
                     concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS line_id,
                     CAST(l_linenumber AS VARCHAR) AS line_number,
                     CASE WHEN l_quantity = 50 THEN NULL WHEN l_quantity = 49 THEN ''
                          WHEN p_brand = 'Brand#25' THEN 'U-' || p_partkey
                          ELSE 'P-' || (p_partkey // 2) END AS part_number,
                     CASE WHEN l_quantity = 48 THEN NULL
                          WHEN l_returnflag = 'A' THEN '  ' || upper(p_name) || ' '
                          ELSE p_name END AS description,
                     p_type AS item_type,
                     CASE WHEN l_tax = 0.08 THEN NULL
                          WHEN l_returnflag = 'R'
                          THEN CAST(CAST(p_retailprice AS DECIMAL(18,4))
                                    + CAST(l_discount AS DECIMAL(18,4)) AS DECIMAL(18,4))
                          ELSE CAST(p_retailprice AS DECIMAL(18,4)) END AS rate,
                     CAST(l_quantity AS INTEGER) AS quantity, l_tax
              FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "v_sections": """
        SELECT doc_id, section_type, section_pos,
               CASE WHEN section_type = 'TAX' AND o_orderpriority = '3-MEDIUM'
                         AND o_orderstatus = 'O' THEN NULL
                    ELSE CAST(amount AS DECIMAL(18,4)) END AS amount
        FROM (
          SELECT 'doc-' || o_orderkey AS doc_id, o_orderstatus, o_orderpriority,
                 s.t AS section_type,
                 CASE WHEN o_orderpriority = '2-HIGH' AND s.t = 'FREIGHT' THEN 3
                      WHEN o_orderpriority = '2-HIGH' AND s.t = 'TAX' THEN 2
                      ELSE s.p END AS section_pos,
                 CASE s.t WHEN 'SUBTOTAL' THEN CAST(o_totalprice AS DECIMAL(18,2))
                          WHEN 'FREIGHT' THEN 12.50 WHEN 'TAX' THEN 7.25
                          ELSE CAST(o_totalprice AS DECIMAL(18,2))
                               + CASE WHEN o_orderstatus = 'F' THEN 20.75 ELSE 19.75 END
                 END AS amount
          FROM orders, (VALUES ('SUBTOTAL', 1), ('FREIGHT', 2), ('TAX', 3), ('TOTAL', 4)) s(t, p))
        WHERE NOT (section_type = 'TAX' AND o_orderpriority = '5-LOW')""",
    "v_log": """
        SELECT event_id AS id, 'P-' || user_id AS part_number,
               CASE WHEN value >= 5 THEN 'INV' || (event_id // 10) END AS invoice_number,
               strftime(ts, '%m/%d/%Y') AS invoice_date,
               CASE WHEN event_type = 'error' AND value < 20 THEN NULL
                    WHEN value < 1 THEN CAST(0 AS DECIMAL(18,4))
                    ELSE CAST(value AS DECIMAL(18,4)) END AS discovered_price,
               CASE WHEN event_type IN ('purchase', 'error')
                    THEN CAST(100 AS DECIMAL(18,4)) END AS authorized_price,
               CASE event_type WHEN 'signup' THEN 'discovered' WHEN 'purchase' THEN 'added'
                    WHEN 'view' THEN 'skipped' WHEN 'click' THEN 'updated'
                    ELSE 'price_mismatch' END AS action_taken,
               CAST(NULL AS VARCHAR) AS user_decision,
               ts AS discovery_date,
               CASE WHEN value > 150 THEN NULL WHEN value > 140 THEN ''
                    ELSE 'session-' || (event_id // 50) END AS processing_session_id,
               CASE WHEN value < 30 THEN props END AS notes
        FROM events""",
    "v_log_entries": """
        SELECT id,
               CASE WHEN discovered_price BETWEEN 1 AND 3 THEN '' ELSE part_number END
                 AS part_number,
               invoice_number, invoice_date, discovered_price, authorized_price,
               CASE WHEN action_taken = 'updated' AND discovered_price < 40 THEN 'collected'
                    ELSE action_taken END AS action_taken,
               user_decision,
               CASE WHEN action_taken = 'skipped' THEN NULL ELSE discovery_date END
                 AS discovery_date,
               processing_session_id, notes
        FROM v_log""",
    "v_import_rows": """
        SELECT p_partkey AS row_no,
               CASE WHEN p_size = 1 THEN '' WHEN p_size <= 25 THEN ' p-' || (p_partkey // 2)
                    ELSE 'n-' || (p_partkey // 4) || ' ' END AS part_number,
               CASE p_size WHEN 2 THEN '' WHEN 3 THEN 'not_a_number' WHEN 4 THEN '-5.00'
                    WHEN 5 THEN '$1,234.56' WHEN 6 THEN '12.34567'
                    ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR) END
                 AS authorized_price,
               CASE WHEN p_size > 25 THEN ' bulk item' ELSE p_name END AS description,
               CASE WHEN p_size > 25 THEN NULL ELSE p_type END AS item_type,
               CASE WHEN p_size < 10 THEN '  ' ELSE 'Import ' || p_type END AS category,
               CASE WHEN p_size = 7 THEN 'batch' WHEN p_size < 30 THEN 'imported'
                    ELSE 'manual' END AS source,
               CASE WHEN p_size < 40 THEN 'True' ELSE 'no' END AS is_active,
               p_brand AS notes
        FROM part""",
    "v_change_rows": """
        SELECT p_partkey AS row_no,
               CASE WHEN p_size = 50 THEN '  ' ELSE 'p-' || (p_partkey * 2 // 3) END
                 AS part_number,
               CASE WHEN p_size < 10 THEN '' WHEN p_size = 11 THEN 'abc' WHEN p_size = 12 THEN '-1'
                    ELSE p_size || '.50' END AS price,
               CASE WHEN p_size BETWEEN 15 AND 30 THEN 'Renamed ' || p_name ELSE '' END
                 AS description,
               CASE WHEN p_size BETWEEN 25 AND 35 THEN 'Bulk' ELSE '' END AS category,
               '' AS notes,
               CASE WHEN p_size > 40 THEN 'active' WHEN p_size > 30 THEN 'no' ELSE '' END AS status
        FROM part""",
    "v_decisions": """
        SELECT composite_key,
               CASE WHEN row_no < 400 THEN 'skip' ELSE 'add_to_database_now' END AS action,
               CASE WHEN row_no < 800 THEN CAST(0 AS DECIMAL(18,4))
                    ELSE CAST(10.25 AS DECIMAL(18,4)) END AS decided_price,
               CAST(NULL AS VARCHAR) AS decided_category
        FROM (SELECT composite_key, min(row_no) AS row_no FROM v_parts_all
              WHERE notes = 'Brand#25' GROUP BY composite_key)""",
    "v_settings": """
        SELECT event_type || '_' || event_id AS key,
               CASE event_type WHEN 'view' THEN CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR)
                    WHEN 'click' THEN CASE WHEN value < 20 THEN 'Yes' WHEN value < 40 THEN 'off'
                                           WHEN value < 60 THEN '1' ELSE 'maybe' END
                    WHEN 'signup' THEN CASE WHEN value < 60 THEN props ELSE '{' || props END
                    WHEN 'purchase' THEN CASE WHEN value < 60 THEN 'n/a' ELSE '12e2' END
                    ELSE 'text ' || user_id END AS value,
               CASE event_type WHEN 'view' THEN 'number' WHEN 'click' THEN 'boolean'
                    WHEN 'signup' THEN 'json' WHEN 'purchase' THEN 'number'
                    ELSE 'string' END AS data_type
        FROM events""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the views it names, directly or through other views."""
    views = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit_view(name)

    def visit_view(name: str) -> None:
        for other in views:
            if other != name and other not in order and re.search(rf"\b{other}\b", views[name]):
                visit_view(other)
        if name not in order:
            order.append(name)

    visit(body)
    if not order:
        return body
    prefix = "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in order)
    if body.lstrip().startswith("WITH "):
        return prefix + ",\n" + body.lstrip()[len("WITH "):]
    return prefix + "\n" + body

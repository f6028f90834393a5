"""Exports: explicit columns first, then a plain Spark writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratecheck.functions.keys import is_blank
from ratecheck.functions.text import money_text
from ratecheck.operators.log import unknown_review
from ratecheck.operators.master import list_parts
from ratecheck.plans.report import REPORT_COLUMNS, TEXT_ORDER

ISO = "yyyy-MM-dd'T'HH:mm:ss"


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def _price(name: str) -> Column:
    return F.substring(money_text(name), 2, 40).alias(name)


def _time(name: str) -> Column:
    return F.coalesce(F.date_format(name, ISO), F.lit("")).alias(name)


def parts_export(master: DataFrame, active_only: bool = False,
                 category: str | None = None) -> DataFrame:
    """The 11-column parts file in key order (A10)."""
    return list_parts(master, active_only, category).select(
        _blank("part_number"), _price("authorized_price"), _blank("description"),
        _blank("item_type"), _blank("category"), _blank("source"), _blank("first_seen_invoice"),
        _time("created_date"), _time("last_updated"), _blank("is_active"), _blank("notes"))


def parts_export_plain(master: DataFrame, active_only: bool = True) -> DataFrame:
    """The 10-column parts file without key columns."""
    return parts_export(master, active_only).drop("item_type")


def parts_export_short(master: DataFrame, active_only: bool = True,
                       category: str | None = None) -> DataFrame:
    """The 8 columns of the CSV / JSON export."""
    return list_parts(master, active_only, category).select(
        "part_number", F.col("authorized_price").cast("double").alias("authorized_price"),
        _blank("description"), _blank("category"), "source", _blank("first_seen_invoice"),
        "is_active", _blank("notes"))


def log_export(log: DataFrame, session_id: str | None = None,
               include_added: bool = False) -> DataFrame:
    """The log file; added rows only on request (A13). Zero prices show as no price."""
    out = log if include_added else log.filter(F.col("action_taken") != "added")
    if session_id:
        out = out.filter(F.col("processing_session_id") == session_id)

    def price(name: str) -> Column:
        return F.when(F.col(name) != 0, F.col(name).cast("double")).alias(name)

    return out.select(
        "part_number", "invoice_number", "invoice_date", price("discovered_price"),
        price("authorized_price"), "action_taken", "user_decision", "processing_session_id",
        "notes", F.date_format("discovery_date", ISO).alias("created_at"))


def unknown_parts_export(log: DataFrame, session_id: str | None = None) -> DataFrame:
    """The review of unknown parts, one row per part.

    The descriptions of a part, of any number, are the rows of ``review_descriptions``.
    """
    return unknown_review(log, session_id).select(
        "part_number", "occurrences", "unique_invoices", "avg_price", "min_price", "max_price",
        "price_variance")


def lines_export(lines: DataFrame, invoices: DataFrame) -> DataFrame:
    """Extracted lines with their invoice number."""
    return lines.join(invoices.select("doc_id", "invoice_number"), "doc_id", "left").select(
        F.col("part_number").alias("item_code"), "description", "item_type", "rate", "quantity",
        "total", "line_number", "raw_text", "invoice_number")


# Fixed value: the name of reports without a number.
NAMELESS = "report"
NAMELESS_TASKS = 64


def report_name(invoice_number) -> Column:
    """File name stem: the invoice number, or 'report' when missing or unknown."""
    number = F.col(invoice_number) if isinstance(invoice_number, str) else invoice_number
    return F.when(is_blank(number) | (F.lower(number) == "unknown"), NAMELESS).otherwise(number)


def dated_reports(reports: DataFrame, run_date: str) -> DataFrame:
    """Reports with the folder and name they are written under."""
    return reports.withColumns({
        "run_date": F.date_format(F.to_date(F.lit(run_date)), "yyyyMMdd"),
        "name": report_name("invoice_number")})


def write_dated(reports: DataFrame, run_date: str, base: str, fmt: str = "json") -> None:
    """Write below ``base/run_date=YYYYMMDD/name=<invoice>/``.

    Rows of a report are brought together first, so no report is spread over files. Reports without
    a number share one name; they are dealt over NAMELESS_TASKS tasks by ``doc_id``, where there is
    one, so that name is no task's burden.
    """
    dated = dated_reports(reports, run_date)
    salt = F.lit(0)
    if "doc_id" in dated.columns:
        salt = F.when(F.col("name") == NAMELESS, F.pmod(F.xxhash64("doc_id"), NAMELESS_TASKS)
                      ).otherwise(0)
    dated.repartition("run_date", "name", salt).write.mode(
        "append").partitionBy("run_date", "name").format(fmt).save(base)


def flat_values(df: DataFrame) -> DataFrame:
    """Values as exports show them: decimals as floats, times as ISO text."""
    def value(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return c.cast("double").alias(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.DateType)):
            return F.date_format(c, ISO).alias(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(c).alias(field.name)
        return c

    return df.select(*[value(f) for f in df.schema.fields])


def write_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a result as csv, json or txt (A12, A18); null is '' in csv and txt."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
        return
    flat = flat_values(df)
    texts = flat.select(*[_blank(c) for c in flat.columns])
    if fmt == "csv":
        texts.write.mode("overwrite").option("emptyValue", "").csv(
            path, header=True, escape='"', encoding="UTF-8")
    elif fmt == "txt":
        texts.select(F.concat_ws("\t", *texts.columns).alias("value")).write.mode(
            "overwrite").text(path)
    else:
        raise ValueError(f"Unknown format: {fmt}")


def write_formats(df: DataFrame, base: str, formats: tuple[str, ...]) -> None:
    """Write one result in several formats, each in its own folder."""
    for fmt in formats:
        write_result(df, f"{base}/{fmt}", fmt)


def anomaly_report(found: DataFrame) -> DataFrame:
    """The anomalies, or one row that says there are none."""
    rows = found.select(
        "doc_id", "line_id", "part_number", "anomaly_type", "severity", "description")
    nothing = rows.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    marker = nothing.select(
        *[F.lit(None).cast("string").alias(c) for c in rows.columns[:-1]],
        F.lit("No anomalies found.").alias("description"))
    return rows.unionByName(marker)


def write_report(report: DataFrame, path: str) -> None:
    """A line, invoice or batch report as CSV parts in report order."""
    report.orderBy(
        F.col("sort_doc").asc_nulls_last(), "sort_block", F.col("row_idx").asc_nulls_last(),
        "line_id").select(*REPORT_COLUMNS).write.mode("overwrite").csv(
        path, header=True, escape='"')


def write_text_report(report: DataFrame, path: str) -> None:
    """A text report as text parts in report order."""
    report.orderBy(*[F.col(c).asc_nulls_first() for c in TEXT_ORDER]).select(
        F.col("text").alias("value")).write.mode("overwrite").text(path)

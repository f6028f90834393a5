"""Document text to invoice headers, section amounts and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratecheck.functions.keys import WHITE, blank_to_null, col, is_blank, strip
from ratecheck.schemas import SECTION_ORDER

MIN_TEXT = 100

# How suppliers write the header fields and section amounts.
INVOICE_NUMBER = [
    r"INVOICE\s+NUMBER\s+(\d+)",
    r"INVOICE\s*#\s*(\d+)",
    r"Invoice\s+Number:\s*(\d+)",
]
INVOICE_DATE = [
    r"INVOICE\s+DATE\s+(\d{2}/\d{2}/\d{4})",
    r"Invoice\s+Date:\s*(\d{2}/\d{2}/\d{4})",
    r"DATE\s+(\d{2}/\d{2}/\d{4})",
]
CUSTOMER_NUMBER = [
    r"CUSTOMER\s+NUMBER\s+(\d+)",
    r"Customer\s+Number:\s*(\d+)",
    r"ACCOUNT\s+NUMBER\s+(\d+)",
]
CUSTOMER_NAME = r"Ship\s+To:\s*([A-Z\s\-]+)"
SECTION_AMOUNTS = {
    "SUBTOTAL": [
        r"SUBTOTAL\s*\(ALL\s+PAGES\)\s+(\d+\.\d{2})",
        r"SUBTOTAL\s+(\d+\.\d{2})",
        r"Sub\s*Total\s*:?\s*\$?(\d+\.\d{2})",
    ],
    "FREIGHT": [
        r"FREIGHT\s+(\d+\.\d{2})",
        r"Freight\s*:?\s*\$?(\d+\.\d{2})",
        r"SHIPPING\s*:?\s*\$?(\d+\.\d{2})",
    ],
    "TAX": [
        r"TAX\s+(\d+\.\d{2})",
        r"Tax\s*:?\s*\$?(\d+\.\d{2})",
        r"SALES\s*TAX\s*:?\s*\$?(\d+\.\d{2})",
    ],
    "TOTAL": [
        r"TOTAL\s+\$(\d+\.\d{2})",
        r"Total\s*:?\s*\$?(\d+\.\d{2})",
        r"GRAND\s*TOTAL\s*:?\s*\$?(\d+\.\d{2})",
    ],
}

# A line holding any of these is a heading or a sum.
SKIP_WORDS = [
    "WEARER#", "WEARER NAME", "ITEM CODE", "ITEM DESCRIPTION", "SIZE", "TYPE", "BILL QTY", "RATE",
    "TOTAL", "SUBTOTAL", "FREIGHT", "TAX ", "THANK YOU", "VISIT US", "BILLING INQUIRIES",
    "CUSTOMER SERVICE", "ACCOUNT NUMBER", "INVOICE NUMBER", "INVOICE DATE", "PAGE ", "SHIP TO",
    "MARKET CENTER", "ROUTE NUMBER",
]
# A line without digits that starts with one of these is a heading.
HEADING_STARTS = ["WEARER", "ITEM", "DESCRIPTION", "SIZE", "TYPE"]

# The three written forms of a line item.
NAME = r"([A-Z][A-Za-z\s\-\.]+?)"
CODE = r"([A-Z0-9]+(?:NAVY|NVOT|CHAR|LGOT|SCGR|BLAK|WHIT|SLVN|GREY)?)"
AMOUNTS = r"(\d+)\s+(\d+\.\d{2,3})\s+(\d+\.\d{2})"
KINDS = r"(Rent|Loss\s+Charge|Ruin\s+charge|PREP\s+CHARGE|X)"
CHARGES = r"(NAME\s+EMBL\s+CHARGE|PREP\s+CHARGE)"
GARMENT_LINE = (
    r"(\d+)\s+" + NAME + r"\s+" + CODE + r"\s+(.+?)\s+([A-Z0-9X]+|X)\s+" + KINDS + r"\s+"
    + AMOUNTS
)
# What any garment line must hold, found without backtracking through names and descriptions: a
# number, two words, and a size before the kind.
GARMENT_SHAPE = r"\d\s+\S+\s+\S+\s+(?:[\s\S]*\s)?[A-Z0-9]+\s+" + KINDS + r"\s+" + AMOUNTS
CHARGE_LINE = r"(\d+)\s+" + NAME + r"\s+" + CHARGES + r"\s+" + AMOUNTS
PLAIN_LINE = r"^" + CODE + r"\s+(.+?)\s+(Rent|X)\s+" + AMOUNTS + r"$"


def document_text(pages: DataFrame) -> DataFrame:
    """Page texts in page order, each ended by a line break (B1).

    The result is one string per document, so a document is bounded by the size of a
    string; the pages of different documents spread freely.
    """
    full = pages.filter(~is_blank("text")).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return full.select("doc_id", F.concat(
        F.array_join(F.col("p.text"), "\n"), F.lit("\n")).alias("text"))


def readable_documents(texts: DataFrame) -> DataFrame:
    return texts.filter(F.length(strip("text")) >= MIN_TEXT)


def unreadable_documents(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents without text or with too little of it, as error rows (B1)."""
    joined = pages.select("doc_id").distinct().join(texts, "doc_id", "left")
    size = F.length(strip(F.coalesce("text", F.lit(""))))
    return joined.filter(size < MIN_TEXT).select(
        "doc_id", F.when(size == 0, "No text could be extracted from PDF").otherwise(
            F.concat(F.lit("Extracted text is too short ("),
                     F.length("text").cast("string"), F.lit(" characters)"))).alias("error"))


def first_match(text, patterns: list[str]) -> Column:
    """Group 1 of the first pattern that matches, case ignored, stripped (B2).

    Blanks in a pattern stand for any white space of Unicode, as PDF text often has hard blanks.
    """
    return F.coalesce(*[
        F.nullif(strip(F.regexp_extract(col(text), f"(?iU){p}", 1)), F.lit("")) for p in patterns])


def invoice_header(texts: DataFrame) -> DataFrame:
    """Number, date, customer, and the names of required fields not found."""
    found = texts.select(
        "doc_id",
        first_match("text", INVOICE_NUMBER).alias("invoice_number"),
        first_match("text", INVOICE_DATE).alias("invoice_date"),
        first_match("text", CUSTOMER_NUMBER).alias("customer_number"),
        blank_to_null(F.regexp_extract("text", "(?U)" + CUSTOMER_NAME, 1)).alias("customer_name"))
    return found.withColumn("missing_fields", F.array_compact(F.array(
        F.when(F.col("invoice_number").isNull(), "invoice_number"),
        F.when(F.col("invoice_date").isNull(), "invoice_date"))))


def header_errors(headers: DataFrame) -> DataFrame:
    return headers.filter(F.size("missing_fields") > 0).select(
        "doc_id", F.concat(F.lit("Required metadata fields missing: "),
                           F.array_join("missing_fields", ", ")).alias("error"))


def text_sections(texts: DataFrame) -> DataFrame:
    """One row per section amount found, in the fixed section order."""
    amounts = F.array(*[
        F.struct(F.lit(kind).alias("section_type"), F.lit(pos).alias("section_pos"),
                 first_match("text", SECTION_AMOUNTS[kind]).try_cast("decimal(18,4)")
                 .alias("amount"))
        for pos, kind in enumerate(SECTION_ORDER, start=1)])
    found = F.filter(amounts, lambda s: s["amount"].isNotNull())
    return texts.select("doc_id", F.inline(found))


def section_errors(texts: DataFrame, sections: DataFrame) -> DataFrame:
    """Documents without exactly four section amounts."""
    counted = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"))
    joined = texts.select("doc_id").join(counted, "doc_id", "left")
    found = F.coalesce("found", F.lit(0).cast("bigint"))
    return joined.filter(found != 4).select(
        "doc_id", F.concat(F.lit("Expected 4 format sections, found "),
                           found.cast("string")).alias("error"))


def _literal(words: list[str]) -> str:
    return "|".join(f"\\Q{w}\\E" for w in words)


def is_heading_line(line) -> Column:
    """Heading or sum, not a line item."""
    upper = F.upper(col(line))
    first_word = F.regexp_extract(upper, f"^{WHITE}*([^{WHITE[1:]}+)", 1)
    return upper.rlike(_literal(SKIP_WORDS)) | (
        first_word.isin(*HEADING_STARTS) & ~col(line).rlike(r"\d"))


def split_lines(texts: DataFrame) -> DataFrame:
    """Non-empty text lines with their 1-based number."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("line_no"),
                        strip("line").alias("line")).filter("line <> ''")


# A separator no invoice text holds.
MARK = "\x01"
# Fixed value: every written form ends in a rate and a total.
HAS_AMOUNTS = r"(?U)\d\.\d{2,3}\s+\d+\.\d{2}"


def _fields(line: Column, pattern: str, tail: str, *wanted: str) -> Column:
    """The wanted groups of the first match, joined by MARK; null when nothing matches.

    One replacement of the whole line yields all groups, so the pattern runs once. The
    patterns backtrack a lot on lines of another form; ``tail``, the closing part they
    must match anyway, sorts those out first.
    """
    whole = "(?sU)" + pattern if pattern.startswith("^") else "(?sU)^.*?" + pattern + ".*$"
    out = F.regexp_replace(line, whole, MARK.join(wanted))
    return F.when(line.rlike("(?U)" + tail), F.when(out.contains(MARK), out))


def parse_line(line) -> Column:
    """A text line as [code, description, type, rate], or null when no form fits.

    The forms are tried in order: garment, special charge, plain item.
    """
    text = col(line)
    return F.split(F.coalesce(
        _fields(text, GARMENT_LINE, GARMENT_SHAPE, "$3", "$4", "$6", "$8"),
        _fields(text, CHARGE_LINE, rf"{CHARGES}\s+{AMOUNTS}", "$3", "$3", "Charge", "$5"),
        _fields(text, PLAIN_LINE, rf"(Rent|X)\s+{AMOUNTS}$", "$1", "$2", "$3", "$5")), MARK)


def text_line_items(lines: DataFrame) -> DataFrame:
    """Line items of ``doc_id, line_no, line`` rows.

    Quantity and total of a text line are not taken over: it counts once at its rate.
    """
    candidates = lines.filter(F.col("line").rlike(HAS_AMOUNTS) & ~is_heading_line("line"))
    # The generator drops lines without a form and evaluates the patterns once per line.
    parsed = candidates.select("doc_id", "line_no", "line", F.explode(
        F.filter(F.array(parse_line("line")), lambda p: p.isNotNull())).alias("p"))
    code, kind = F.col("p")[0], F.col("p")[2]
    rate = F.col("p")[3].try_cast("decimal(18,4)")
    return parsed.select(
        "doc_id", F.col("line_no").cast("bigint").alias("row_idx"),
        F.col("line_no").cast("string").alias("line_id"),
        F.col("line_no").cast("string").alias("line_number"),
        F.when(kind == "Charge", F.replace(code, F.lit(" "), F.lit("_"))).otherwise(code)
        .alias("part_number"),
        strip(F.col("p")[1]).alias("description"), kind.alias("item_type"), rate.alias("rate"),
        F.lit(1).alias("quantity"), rate.alias("total"), F.col("line").alias("raw_text"))


def documents_without_items(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Documents in which no line item was found."""
    return lines.select("doc_id").distinct().join(
        items.select("doc_id").distinct(), "doc_id", "left_anti").withColumn(
        "error", F.lit("No valid line items found in invoice"))

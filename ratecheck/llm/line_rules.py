"""Line-first cleaning: rules per line, then a verdict on what is left of the document.

Everything is an expression over one row, so a plan is a scan and projections: no shuffle,
whatever group or source a document belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratecheck.llm.common import words

WORD_CHARACTER = r"[^\x20\x09-\x0D]"

# Symbols counted by the base rules, and the parameters of the base rules.
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

# Phrases that mark a line as page furniture, in lower case.
BOILERPLATE = [
    "accept all cookies", "all rights reserved", "click here to", "enable javascript",
    "javascript is disabled", "lorem ipsum", "privacy policy", "read more", "sign up for our",
    "skip to content", "subscribe to our newsletter", "terms of service", "terms of use",
    "this site uses cookies", "use of cookies", "we use cookies",
]
# A separator that stands alone between the entries of a menu or a table.
SEPARATOR = r"(?:^|[\x20\x09-\x0D])[|>/»›·•:]{1,2}(?=[\x20\x09-\x0D]|$)"


def line_verdict(line: Column, max_mark_share: float = 0.1, max_separator_share: float = 0.2
                 ) -> Column:
    """The name of the first rule that a line fails; null if it passes.

    ``punctuation``: more than ``max_mark_share`` of its characters are symbols, or more than
    a third of its words end in a doubled exclamation or question mark. ``navigation``:
    stand-alone separators are more than ``max_separator_share`` of its words.
    ``boilerplate``: it holds one of the listed phrases.
    """
    length = F.length(line)
    count = F.regexp_count(line, F.lit(WORD_CHARACTER + "+"))
    marks = F.regexp_count(line, F.lit(SYMBOLS))
    shouts = F.regexp_count(line, F.lit(r"[!?]{2,}(?=[\x20\x09-\x0D]|$)"))
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    return (
        F.when(separators > count * max_separator_share, "navigation")
        .when((marks > length * max_mark_share) | (shouts * 3 > count), "punctuation")
        .when(F.lower(line).rlike("|".join(BOILERPLATE)), "boilerplate")
    )


def repeated_words(df: DataFrame, tokens: str, out: str, window: int = WINDOW) -> DataFrame:
    """Count the words that lie in a window found twice or more in the same row.

    Windows are compared by a 64-bit hash chained over their words. Rows whose windows are
    all different, most of them, stop at a hash set; the others sort theirs.
    """
    n = F.size(tokens)
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window))
    df = df.withColumn("_grams", F.transform(
        starts, lambda i: F.xxhash64(*[F.get(F.col(tokens), i + k) for k in range(window)])))
    df = df.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_grams")) < F.size("_grams"),
        F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_sorted", lambda x, k: (
        (F.get("_sorted", k - 1)["h"] == x["h"]).eqNullSafe(True)
        | (F.get("_sorted", k + 1)["h"] == x["h"]).eqNullSafe(True)))
    df = df.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "_at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct(
            (acc["n"] + i + window - F.greatest(i, acc["end"])).alias("n"),
            (i + window).alias("end")))
    return (df.withColumn(out, F.coalesce(covered["n"], F.lit(0)).cast("long"))
            .drop("_grams", "_sorted", "_at"))


def clean_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                max_lost: float = 0.5) -> DataFrame:
    """Judge every document of a table by its lines.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, failed_lines, lost_share, clean_text``, one row for each input row, repeated rows and
    null ids included. A line is judged if it has a word; it goes if it fails a rule of
    ``line_verdict``. A document is kept if the base rules pass and its failed lines hold at
    most ``max_lost`` of the characters of its judged lines. ``clean_text`` joins the lines
    that stay. A null or empty text has no words, fails the base rules, and its clean text is
    empty. Other columns of the table are not read.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    df = docs.select(F.col(id_column).alias("doc_id"), text.alias("_text"))
    df = df.select(
        "doc_id", "_text", words(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD_CHARACTER)).alias("_lines"))
    df = df.select(
        "doc_id", "_words", "_lines",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
        .alias("n_dup_lines"),
        F.transform("_lines", lambda x: line_verdict(x).isNotNull()).alias("_failed"))
    df = repeated_words(df, "_words", "n_repeat_words").drop("_words")
    lengths = F.aggregate(
        F.zip_with("_lines", "_failed", lambda x, bad: F.struct(
            F.length(x).cast("long").alias("n"), bad.alias("bad"))),
        F.struct(F.lit(0).cast("long").alias("all"), F.lit(0).cast("long").alias("lost"),
                 F.lit(0).cast("long").alias("lines")),
        lambda acc, x: F.struct(
            (acc["all"] + x["n"]).alias("all"),
            (acc["lost"] + F.when(x["bad"], x["n"]).otherwise(0)).alias("lost"),
            (acc["lines"] + F.when(x["bad"], 1).otherwise(0)).alias("lines")))
    df = df.withColumn("_sum", lengths)
    failed = ((F.col("n_words") < MIN_WORDS)
              | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    lost = F.coalesce(F.try_divide(F.col("_sum.lost"), F.col("_sum.all")), F.lit(0.0))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (lost <= max_lost)).alias("kept"),
        F.col("_sum.lines").alias("failed_lines"), lost.alias("lost_share"),
        F.array_join(F.filter("_lines", lambda x, i: ~F.get("_failed", i)), "\n")
        .alias("clean_text"))

"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ratecheck.llm import (
    hard_negatives, interpolated_lm, line_rules, list_views, oracle, phrase_index, quality_model,
    shards, simhash, source_mix, toxicity, turn_oracle, turn_repair, url_lists, warc_store,
    window_dedup,
)
from ratecheck.llm.common import table


def op1_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    spans = url_lists.intervals(list_views.entries(pages))
    judged = url_lists.judge(list_views.captures(pages), spans)
    return judged.select(F.col("id").alias("page_id"), "host", "fetched", "n_active", "lists",
                         "verdict")


def op2_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    laid, schedule = source_mix.mix(table(spark, folder, "documents"))
    return source_mix.taken_words(laid, schedule)


def op3_warc_store(spark: SparkSession, folder: str) -> DataFrame:
    archive = warc_store.write_archive(table(spark, folder, "pages"))
    return warc_store.read_index(spark, archive).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    printed, named = simhash.groups(table(spark, folder, "documents"))
    return printed.join(named, "print").select(
        "doc_id", simhash.hexadecimal(F.col("print")).alias("fingerprint"), "component_id")


def op6_shards(spark: SparkSession, folder: str) -> DataFrame:
    dealt = shards.shard(table(spark, folder, "documents"))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op7_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = line_rules.clean_lines(table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op9_phrase_index(spark: SparkSession, folder: str) -> DataFrame:
    found = phrase_index.phrase_matches(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op10_window_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = window_dedup.remove_repeats(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed",
                          F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_interpolated_lm(spark: SparkSession, folder: str) -> DataFrame:
    return interpolated_lm.score(table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = hard_negatives.quantised(table(spark, folder, "embeddings"))
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op13_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.damage_and_repair(table(spark, folder, "conversations")).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        "repaired_sha256")


QUERIES = {
    "op1_url_lists": op1_url_lists,
    "op2_source_mix": op2_source_mix,
    "op3_warc_store": op3_warc_store,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_shards": op6_shards,
    "op7_quality_model": op7_quality_model,
    "op8_line_rules": op8_line_rules,
    "op9_phrase_index": op9_phrase_index,
    "op10_window_dedup": op10_window_dedup,
    "op11_interpolated_lm": op11_interpolated_lm,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_turn_repair": op13_turn_repair,
}

ORACLE = {
    "op1_url_lists": list_views.URL_LISTS_SQL,
    "op2_source_mix": oracle.SOURCE_MIX,
    "op3_warc_store": oracle.WARC_STORE,
    "op6_shards": oracle.SHARDS,
    "op8_line_rules": oracle.LINE_RULES,
    "op9_phrase_index": oracle.PHRASE_INDEX,
    "op10_window_dedup": oracle.WINDOW_DEDUP,
    "op12_hard_negatives": oracle.HARD_NEGATIVES,
    "op13_turn_repair": turn_oracle.TURN_REPAIR,
}

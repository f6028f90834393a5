"""Benchmark decontamination with a positional inverted index.

Test items are cut into phrases of consecutive words. The index holds (term, document, position)
postings of the training table for the rarest terms of each phrase. Posting lists, shifted by
the terms' offsets in the phrase, are intersected from the rarest term on; what is left is
checked word by word in its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratecheck.llm.common import small, stage

PHRASE_WORDS = 10
ANCHORS = 2
BROADCAST_ROWS = 200_000
# What parts words before A-Z are lowered: ASCII without letters and digits.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(word: Column) -> Column:
    """Lower-case A-Z only; words of ASCII alone take the fast way."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def raw_terms(text: Column) -> Column:
    """Words between ASCII characters that are neither letters nor digits, case kept."""
    text = F.coalesce(text, F.lit(""))
    return F.array_remove(F.split(text, BREAK), "")


def terms(text: Column) -> Column:
    return F.transform(raw_terms(text), lower_ascii)


def phrases(items: DataFrame, length: int = PHRASE_WORDS) -> DataFrame:
    """``item_id, phrase``: every run of ``length`` words of an item, joined by spaces.

    An item of fewer words, but not none, is one phrase. Items need ``item_id`` and ``text``.
    """
    cut = items.select("item_id", terms(F.col("text").cast("string")).alias("w"))
    n = F.size("w")
    starts = F.when(n == 0, F.array()).when(n <= length, F.array(F.lit(1))).otherwise(
        F.sequence(F.lit(1), n - length + 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(length)), " "))
    return cut.select("item_id", F.explode(F.array_distinct(runs)).alias("phrase")).distinct()


def tokens(docs: DataFrame) -> DataFrame:
    """One row per word: the document's key, the term, and its position from 0."""
    cut = docs.select("id", "tag", F.posexplode(raw_terms(F.col("text"))).alias("pos", "w"))
    return cut.select("id", "tag", "pos", lower_ascii(F.col("w")).alias("term"))


def anchors(docs: DataFrame, wanted: DataFrame, count: int = ANCHORS) -> DataFrame:
    """The rarest terms of each phrase: ``phrase, term, off, rank, need``.

    Frequencies are counted over all documents. A phrase with a term that no document has cannot
    occur and has no anchors.
    """
    placed = stage(wanted.select("phrase").distinct().select(
        "phrase", F.size(F.split("phrase", " ")).alias("n"),
        F.posexplode(F.split("phrase", " ")).alias("off", "term")), "phrase-terms")
    vocabulary = stage(placed.select("term").distinct(), "vocabulary")
    counts = tokens(docs).select("term").join(small(vocabulary, BROADCAST_ROWS), "term").groupBy(
        "term").count()
    counted = placed.join(counts, "term")
    own = Window.partitionBy("phrase")
    ranked = counted.withColumn("known", F.count("*").over(own)).filter("known = n").withColumn(
        "rank", F.row_number().over(own.orderBy("count", "off")))
    return stage(ranked.filter(F.col("rank") <= count).select(
        "phrase", "term", "off", "rank", F.least(F.col("n"), F.lit(count)).alias("need")),
        "anchors")


def index(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The stored postings ``term, id, tag, pos`` of the chosen terms."""
    vocabulary = stage(chosen.select("term").distinct(), "index-terms")
    found = tokens(docs).join(small(vocabulary, BROADCAST_ROWS), "term")
    return stage(found.select("term", "id", "tag", "pos"), "postings")


def candidates(postings: DataFrame, chosen: DataFrame) -> DataFrame:
    """``phrase, id, tag, start`` where all anchors of a phrase stand at their offsets.

    Anchors are met, not counted: rows of one id and text share their postings.
    """
    shifted = postings.join(small(chosen, BROADCAST_ROWS), "term").select(
        "phrase", "id", "tag", (F.col("pos") - F.col("off")).alias("start"), "need",
        F.call_function("shiftleft", F.lit(1).cast("long"), F.col("rank") - 1).alias("bit"))
    met = shifted.filter("start >= 0").groupBy("phrase", "id", "tag", "start").agg(
        F.bit_or("bit").alias("bits"), F.first("need").alias("need"))
    return met.filter(F.bit_count("bits") == F.col("need")).select("phrase", "id", "tag", "start")


def near_candidates(postings: DataFrame, chosen: DataFrame, slack: int) -> DataFrame:
    """``phrase, id, tag, start``: the rarest terms stand at most ``slack`` words out of place.

    The places of the second term are dealt into cells of ``slack + 1`` words, so each place of
    the first meets three cells at most.
    """
    chosen = small(chosen, BROADCAST_ROWS)
    shifted = postings.join(chosen, "term").select(
        "phrase", "id", "tag", (F.col("pos") - F.col("off")).alias("start"), "rank", "need")
    first = shifted.filter("rank = 1")
    cell = F.floor(F.col("start") / (slack + 1))
    alone = first.filter("need = 1").select("phrase", "id", "tag", "start")
    left = first.filter("need > 1").select(
        "phrase", "id", "tag", "start",
        F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    right = shifted.filter("rank = 2").select(
        "phrase", "id", "tag", F.col("start").alias("other"), cell.alias("cell"))
    both = left.join(right, ["phrase", "id", "tag", "cell"]).filter(
        F.abs(F.col("start") - F.col("other")) <= slack)
    return alone.union(both.select("phrase", "id", "tag", "start")).distinct()


def exact(place: Column, found: Column) -> Column:
    """Whether the phrase of a candidate stands in the words at its start."""
    wanted = F.split(place["phrase"], " ")
    return F.slice(found, place["start"] + 1, F.size(wanted)) == wanted


def prepared(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Documents by key: the id and a checksum of the text, which tells rows of one id apart."""
    text = F.col(text_column).cast("string")
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("tag"),
                       text.alias("text"))


def by_document(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Bring each document its candidate places; documents without any stay."""
    held = places.groupBy("id", "tag").agg(
        F.collect_list(F.struct("start", "phrase")).alias("places")).select(
        F.col("id").alias("_id"), F.col("tag").alias("_tag"), "places")
    return docs.join(held, docs["id"].eqNullSafe(held["_id"]) & (docs["tag"] == held["_tag"]),
                     "left").drop("_id", "_tag")


def phrase_matches(docs: DataFrame, items: DataFrame, length: int = PHRASE_WORDS,
                   id_column: str = "doc_id", text_column: str = "text",
                   item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Find test phrases in every document, word for word.

    Returns one row per document: ``doc_id, tag, n_words, n_hit, n_items, items, spans``. ``tag`` is
    a checksum of the text; ``n_hit`` counts words inside any occurrence of a phrase; ``items`` are the ids, as sorted text, of the items
    with an occurring phrase (a null id reads ``null``, a repeated id counts once), ``n_items``
    their number; ``spans`` are the merged places of the hits. Null and empty texts have no
    words and no hits; items without words have no phrase. Null ids and repeated rows are rows
    like any other. Without items, or without documents, nothing is hit. Other columns are not
    read.
    """
    items = items.select(
        F.coalesce(F.col(item_column).cast("string"), F.lit("null")).alias("item_id"),
        F.col(item_text).cast("string").alias("text"))
    rows = prepared(docs, id_column, text_column)
    wanted = stage(phrases(items, length), "phrases")
    chosen = anchors(rows, wanted)
    places = candidates(index(rows, chosen), chosen)
    joined = by_document(rows, places).select(
        "id", "tag", "places", terms(F.col("text")).alias("w"))
    found = joined.select(
        "id", "tag", F.size("w").cast("long").alias("n_words"),
        F.filter("places", lambda x: exact(x, F.col("w"))).alias("hits"))
    spans = F.sort_array(F.transform("hits", lambda x: F.struct(
        x["start"].alias("start"), (x["start"] + F.size(F.split(x["phrase"], " "))).alias("stop"))))
    merged = F.aggregate(
        spans, F.array().cast("array<struct<start:int,stop:int>>"),
        lambda acc, x: F.when(
            F.coalesce(F.try_element_at(acc, F.lit(-1))["stop"] >= x["start"], F.lit(False)),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
                F.try_element_at(acc, F.lit(-1))["start"].alias("start"),
                F.greatest(F.try_element_at(acc, F.lit(-1))["stop"], x["stop"]).alias("stop")))),
        ).otherwise(F.concat(acc, F.array(x))))
    found = stage(found.select(
        "id", "tag", "n_words", F.coalesce(merged, F.array().cast(
            "array<struct<start:int,stop:int>>")).alias("spans"),
        F.array_distinct(F.transform("hits", lambda x: x["phrase"])).alias("found")), "found")
    named = found.select("id", "tag", F.explode("found").alias("phrase")).distinct().join(
        wanted, "phrase").select("id", "tag", "item_id").distinct()
    named = named.groupBy(F.col("id").alias("_id"), F.col("tag").alias("_tag")).agg(
        F.sort_array(F.collect_list("item_id")).alias("items"))
    hit = F.aggregate("spans", F.lit(0), lambda n, x: n + x["stop"] - x["start"])
    return found.join(named, found["id"].eqNullSafe(named["_id"]) & (found["tag"] == named["_tag"]),
                      "left").select(
        F.col("id").alias("doc_id"), "tag", "n_words", hit.cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


def near_matches(docs: DataFrame, items: DataFrame, slack: int = 3, length: int = PHRASE_WORDS,
                 id_column: str = "doc_id", text_column: str = "text",
                 item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Proximity: ``doc_id, item_id, phrase, start`` where a phrase's words stand close together.

    The two rarest terms are within ``slack`` words of their places, and every word of the phrase
    is found within ``slack`` words of where the phrase would stand. Edge cases are those of
    ``phrase_matches``; repeated rows of one id and text report once.
    """
    items = items.select(
        F.coalesce(F.col(item_column).cast("string"), F.lit("null")).alias("item_id"),
        F.col(item_text).cast("string").alias("text"))
    rows = prepared(docs, id_column, text_column)
    wanted = stage(phrases(items, length), "phrases")
    chosen = anchors(rows, wanted)
    places = near_candidates(index(rows, chosen), chosen, slack)
    joined = by_document(rows, places).filter("places is not null").select(
        "id", "places", terms(F.col("text")).alias("w"))

    def near(x: Column) -> Column:
        wanted_words = F.split(x["phrase"], " ")
        begin = F.greatest(x["start"] - slack, F.lit(0))
        around = F.slice(F.col("w"), begin + 1,
                         x["start"] + F.size(wanted_words) + slack - begin)
        return F.size(F.array_except(wanted_words, around)) == 0

    found = joined.select("id", F.explode(F.filter("places", near)).alias("place"))
    return found.select("id", "place.phrase", "place.start").distinct().join(
        wanted, "phrase").select(F.col("id").alias("doc_id"), "item_id", "phrase", "start")

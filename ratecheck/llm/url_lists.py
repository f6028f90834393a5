"""URL filters: dated list entries joined to captures as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ratecheck.llm.common import stage

PERIOD_DAYS = 90
KINDS = ("domain", "prefix", "url")


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port or final dot; else null."""
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(place, "^.*@", ""), r"\.?(:[0-9]*)?$", "")
    return F.nullif(F.lower(bare), F.lit(""))


def path_of(url: Column) -> Column:
    """Path of an absolute URL, without query and fragment; empty where there is none."""
    return F.coalesce(
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def parts_of(path: Column) -> Column:
    return F.array_remove(F.split(path, "/"), "")


def url_key(url: Column) -> Column:
    """The form in which whole URLs are listed: host, path and query, no scheme or fragment."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    return F.concat(host_of(url), rest)


def intervals(entries: DataFrame) -> DataFrame:
    """Turn dated entries into validity intervals: ``[since, until)`` with ``until`` null if open.

    Entries have ``list, verdict, kind, key, action, listed_on``: from the start of its date an
    ``add`` puts the key on the list until the next ``remove`` of that list, kind and key. An
    add and a remove on one date count as an add; repeated adds change nothing. Entries with a
    null in any of these columns, an unknown kind or action say nothing and are left out. A key
    has at most one entry per date left, so its window is bounded by the calendar.
    """
    fields = ["list", "kind", "key", "listed_on"]
    known = entries.select("verdict", "action", *fields).dropna().filter(
        F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove"))
    daily = known.groupBy(*fields).agg(
        F.max(F.col("action") == "add").alias("active"),
        F.min(F.when(F.col("action") == "add", F.col("verdict"))).alias("verdict"))
    own = Window.partitionBy("list", "kind", "key").orderBy("listed_on")
    changes = daily.withColumn("_was", F.lag(F.struct("active", "verdict")).over(own)).filter(
        F.col("_was").isNull() | (F.col("_was.active") != F.col("active"))
        | ~F.col("_was.verdict").eqNullSafe(F.col("verdict")))
    spans = changes.withColumn("until", F.lead("listed_on").over(own))
    return spans.filter("active").select(
        "list", "verdict", "kind", "key", F.col("listed_on").alias("since"), "until")


def candidate_keys(url: Column, host: Column, depth: int) -> Column:
    """Every (kind, key) under which a URL can be listed: parent domains, path prefixes, itself.

    ``depth`` is the deepest listed prefix, so no listed prefix is missed.
    """
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"),
        F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    parts = parts_of(path_of(url))
    steps = F.least(F.size(parts), F.lit(depth))
    prefixes = F.when(steps > 0, F.transform(F.sequence(F.lit(1), steps), lambda i: F.struct(
        F.lit("prefix").alias("kind"),
        F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("key")
    ))).otherwise(F.array())
    whole = F.array(F.struct(F.lit("url").alias("kind"), url_key(url).alias("key")))
    return F.concat(domains, prefixes, whole)


def judge(captures: DataFrame, spans: DataFrame, id_column: str = "page_id",
          url_column: str = "url", time_column: str = "fetched",
          period_days: int = PERIOD_DAYS) -> DataFrame:
    """Evaluate every capture against the entries active when it was fetched.

    Returns ``id, url, host, fetched, n_active, lists, verdict``, one row per capture, repeated rows
    kept. ``lists`` names the lists with an active entry, sorted and comma-joined. ``verdict``
    is that of the most specific active entry (the longest key; of equals the smallest verdict
    by name), or null if none is active. A capture with a null or relative URL or a null time
    matches nothing. Other columns are not read.

    Intervals are cut into periods, so the as-of condition becomes an equi-join on key and
    period plus a comparison inside one period; Spark splits a hot host by measured size.
    """
    rows = captures.select(
        F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"),
        F.col(time_column).cast("timestamp").alias("fetched"))
    # Repeated rows are judged once and dealt out again at the end.
    rows = rows.groupBy("id", "url", "fetched").count()
    spans = stage(spans, "spans")
    depth, first, last = spans.agg(
        F.max(F.when(F.col("kind") == "prefix", F.size(F.split("key", "/")) - 1)),
        F.min("since"), F.max(F.greatest("since", "until"))).first()

    def period(day: Column) -> Column:
        return F.floor(F.unix_date(day) / period_days)

    newest = rows.agg(F.max("fetched")).first()[0]
    horizon = F.lit(newest.date() if newest else last).cast("date")
    # An interval reaches no further than the newest capture; one that starts later is moot.
    pieces = spans.filter(F.col("since") <= horizon).withColumn("period", F.explode(F.sequence(
        period(F.col("since")), period(F.least(F.date_sub("until", 1), horizon)))))
    keyed = rows.withColumn("host", host_of(F.col("url"))).select(
        "id", "url", "fetched", "host",
        F.explode(candidate_keys(F.col("url"), F.col("host"), depth or 0)).alias("at"))
    keyed = keyed.select("id", "url", "fetched", period(F.to_date("fetched")).alias("period"),
                         F.col("at.kind").alias("kind"), F.col("at.key").alias("key"))
    active = keyed.join(pieces, ["kind", "key", "period"]).filter(
        (F.to_date("fetched") >= F.col("since"))
        & (F.col("until").isNull() | (F.to_date("fetched") < F.col("until"))))
    found = active.groupBy("id", "url", "fetched").agg(
        F.count("*").alias("n_active"),
        F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"),
        F.min(F.struct(-F.length("key"), F.col("verdict"))).getField("verdict").alias("verdict"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("id", "url", "fetched")]
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("r.count")))
    return rows.alias("r").join(found.alias("f"), same, "left").select(
        "r.id", "r.url", host_of(F.col("r.url")).alias("host"), "r.fetched",
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("lists", F.lit("")).alias("lists"), "verdict", copies.alias("_copy")
    ).drop("_copy")

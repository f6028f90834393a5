"""Captures and dated list entries derived from ``pages``, in Spark and in SQL.

``pages`` has neither fetch times nor lists. A hash of the page id gives the fetch hour within
2024; hashes of hosts, host paths and whole URLs decide which of them are listed, on which list
and on which dates. So the lists grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ratecheck.llm.common import digest_number
from ratecheck.llm.url_lists import host_of, parts_of, path_of, url_key

HOURS = 366 * 24


def captures(pages: DataFrame) -> DataFrame:
    hour = digest_number(F.col("page_id")) % HOURS
    return pages.select(
        "page_id", "url",
        F.timestamp_seconds(F.lit(1704067200) + hour * 3600).alias("fetched"))


def entries(pages: DataFrame) -> DataFrame:
    """Two spells on a list for listed keys: an add, a remove, and an add again."""
    urls = pages.select(F.col("url"), host_of(F.col("url")).alias("host")).dropna()
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    section = F.concat("host", F.lit("/"), F.get(parts_of(path_of(F.col("url"))), F.lit(0)))

    def named(kind: str, key: Column) -> DataFrame:
        return urls.select(F.lit(kind).alias("kind"), key.alias("key")).dropna().distinct()

    keys = named("domain", F.col("host")).union(named("domain", parent)).distinct().union(
        named("prefix", section)).union(named("url", url_key(F.col("url"))))
    keys = keys.withColumn("h", digest_number(F.col("key")))
    listed = keys.filter(
        ((F.col("kind") == "domain") & (F.col("h") % 3 == 0))
        | ((F.col("kind") == "prefix") & (F.col("h") % 4 == 0))
        | ((F.col("kind") == "url") & (F.col("h") % 10 == 0)))
    kind_of_list = F.when(F.col("h") % 7 == 0, "trusted").when(F.col("h") % 2 == 0, "spam").otherwise(
        "malware")
    start = (F.col("h") % 200).cast("int")
    length = (F.floor(F.col("h") / 200) % 90 + 1).cast("int")
    day = F.lit("2024-01-01").cast("date")
    changes = F.array(*[
        F.struct(F.lit(action).alias("action"), F.date_add(day, offset).alias("listed_on"))
        for action, offset in (("add", start), ("remove", start + length),
                               ("add", start + length * 2))])
    return listed.select(
        kind_of_list.alias("list"),
        F.when(F.col("h") % 7 == 0, "allow").otherwise("block").alias("verdict"),
        "kind", "key", F.explode(changes).alias("change")).select(
        "list", "verdict", "kind", "key", "change.action", "change.listed_on")


URL_LISTS_SQL = r"""
WITH parsed AS (
  SELECT page_id, url,
    TIMESTAMP '2024-01-01' + to_hours(CAST(
      ('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 15))::BIGINT % (366 * 24) AS INTEGER)) AS fetched,
    nullif(lower(regexp_replace(regexp_replace(
      regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''),
      '\.?(:[0-9]*)?$', '')), '') AS host,
    list_filter(string_split(
      regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?', 1), '/'),
      lambda x: x <> '') AS parts,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)', 1) AS rest
  FROM pages),
keys AS (
  SELECT kind, key, ('0x' || substr(md5(key), 1, 15))::BIGINT AS h FROM (
    SELECT 'domain' AS kind, host AS key FROM parsed
    UNION SELECT 'domain', regexp_replace(host, '^[^.]*\.', '') FROM parsed
    UNION SELECT 'prefix', host || '/' || parts[1] FROM parsed
    UNION SELECT 'url', host || rest FROM parsed) WHERE key IS NOT NULL),
listed AS (
  SELECT kind, key, CASE WHEN h % 7 = 0 THEN 'trusted' WHEN h % 2 = 0 THEN 'spam' ELSE 'malware' END AS list,
    CASE WHEN h % 7 = 0 THEN 'allow' ELSE 'block' END AS verdict,
    CAST(h % 200 AS INTEGER) AS start, CAST((h // 200) % 90 + 1 AS INTEGER) AS len
  FROM keys WHERE (kind = 'domain' AND h % 3 = 0) OR (kind = 'prefix' AND h % 4 = 0)
    OR (kind = 'url' AND h % 10 = 0)),
spans AS (
  SELECT kind, key, list, verdict, DATE '2024-01-01' + start AS since,
    DATE '2024-01-01' + start + len AS until FROM listed
  UNION ALL SELECT kind, key, list, verdict, DATE '2024-01-01' + start + 2 * len, NULL FROM listed),
candidates AS (
  SELECT page_id, url, fetched, 'domain' AS kind,
    array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS key
  FROM (SELECT *, unnest(generate_series(1, len(string_split(host, '.')))) AS i FROM parsed)
  UNION ALL SELECT page_id, url, fetched, 'prefix',
    host || '/' || array_to_string(list_slice(parts, 1, i), '/')
  FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM parsed)
  UNION ALL SELECT page_id, url, fetched, 'url', host || rest FROM parsed),
active AS (
  SELECT c.page_id, c.url, c.fetched, s.list, s.verdict, length(c.key) AS size
  FROM candidates c JOIN spans s ON c.kind = s.kind AND c.key = s.key
    AND CAST(c.fetched AS DATE) >= s.since
    AND (s.until IS NULL OR CAST(c.fetched AS DATE) < s.until))
SELECT p.page_id, p.host, p.fetched,
  (SELECT count(*) FROM active a WHERE a.page_id = p.page_id) AS n_active,
  coalesce((SELECT string_agg(list, ',' ORDER BY list) FROM
    (SELECT DISTINCT list FROM active a WHERE a.page_id = p.page_id)), '') AS lists,
  (SELECT verdict FROM active a WHERE a.page_id = p.page_id ORDER BY size DESC, verdict LIMIT 1)
    AS verdict
FROM parsed p
"""

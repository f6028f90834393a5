"""DuckDB twins of the queries, each written from the definition and not from the operator."""

LINE_RULES = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT *, list_transform(generate_series(1, len(w) - 4),
    lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) AS g FROM cut),
placed AS (
  SELECT doc_id, unnest(g) AS gram, unnest(generate_series(1, len(g))) AS i FROM grams),
repeats AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM placed),
    generate_series(0, 4) AS t(o)
  WHERE c > 1 GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, length(line) AS n,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS marks,
    len(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
      lambda x: regexp_matches(x, '[!?]{2,}$'))) AS shouts,
    len(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
      lambda x: regexp_full_match(x, '[|>/»›·•:]{1,2}'))) AS separators
  FROM (SELECT doc_id, unnest(lines) AS line FROM cut)),
lost AS (
  SELECT doc_id, sum(CASE WHEN separators > words * 0.2 OR marks > n * 0.1 OR shouts * 3 > words
      OR regexp_matches(lower(line), 'accept all cookies|all rights reserved|click here to|enable javascript|javascript is disabled|lorem ipsum|privacy policy|read more|sign up for our|skip to content|subscribe to our newsletter|terms of service|terms of use|this site uses cookies|use of cookies|we use cookies')
    THEN n ELSE 0 END) AS lost, sum(n) AS whole
  FROM lines GROUP BY doc_id)
SELECT g.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w) AS base_failed,
  NOT (len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w))
    AND coalesce(l.lost, 0) <= 0.5 * coalesce(l.whole, 0) AS kept
FROM grams g LEFT JOIN repeats r ON g.doc_id = r.doc_id LEFT JOIN lost l ON g.doc_id = l.doc_id
"""

PHRASE_INDEX = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
    array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS phrase
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM phrases),
places AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase
  FROM (SELECT *, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lengths)),
hits AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN phrases q ON p.phrase = q.phrase),
words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

WINDOW_DEDUP = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS seq
  FROM (SELECT *, unnest(generate_series(1, len(w) - 12)) AS i FROM d)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY seq) AS first FROM windows)
  WHERE doc_id > first),
gone AS (
  SELECT doc_id, list(DISTINCT j) AS gone
  FROM (SELECT doc_id, unnest(generate_series(i, i + 12)) AS j FROM later) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text FROM (
    SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS j FROM d) x
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS j FROM gone) y
    WHERE y.doc_id = x.doc_id AND y.j = x.j) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

# Water level: caps are met in the order of cap / weight; the level is the first that its
# source can take.
SOURCE_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)
    AS size, ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS place
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2.0 * source_size AS cap, (1.5 * sum(source_size) OVER ()
      - coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight
          RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0))
    / sum(weight) OVER (ORDER BY 2.0 * source_size / weight
          RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM sources),
water AS (SELECT coalesce((SELECT level FROM levels WHERE level * weight <= cap
  ORDER BY cap / weight LIMIT 1), 1e300) AS level),
targets AS (
  SELECT source, source_size, CAST(least(cap, weight * water.level) AS DOUBLE) AS target,
    CAST(floor(least(cap, weight * water.level) + 0.5) AS BIGINT) AS goal FROM levels, water),
laid AS (
  SELECT doc_id, size, source_size, target, goal, CAST(sum(size) OVER (PARTITION BY s.source
    ORDER BY place, doc_id, text ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS off
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(off + size, goal) - off)
    + greatest(0, least(off + source_size + size, goal) - off - source_size) AS BIGINT) AS taken
FROM laid
"""

WARC_STORE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (
  SELECT *, sha1(body) AS h, octet_length(encode(body)) AS n,
    max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER))
      & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

# Records in the order of the two hashes; a group is dealt whole if it is within one of the
# 1,024 shares, else row by row. The checksum is computed bit by bit from its polynomial.
SHARDS = r"""
WITH crc AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1) AS g,
    coalesce(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT, -1) AS r
  FROM documents),
sums AS (
  SELECT d.*, sum(size) OVER () AS total, sum(size) OVER w - size AS byte, row_number() OVER w - 1 AS place,
    sum(size) OVER (PARTITION BY g) AS together
  FROM d WINDOW w AS (ORDER BY g, r, doc_id, size ROWS UNBOUNDED PRECEDING)),
dealt AS (
  SELECT *, CAST(least(15, CASE WHEN together * 1024 <= total
      THEN (2 * min(byte) OVER (PARTITION BY g) + together) * 16 // (2 * total)
      ELSE (2 * byte + size) * 16 // (2 * total) END) AS INTEGER) AS shard FROM sums)
SELECT doc_id, CAST(size AS BIGINT) AS size,
  xor(list_reduce(list_concat([4294967295], list_transform(range(size - 1), lambda i:
      ('0x' || substr(hex(encode(text)), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
    lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32,
  'bytes' AS law, shard, CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM dealt, crc
"""

# All anchors against all rows, ranked as stated.
HARD_NEGATIVES = r"""
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same,
    CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM r AS a, r WHERE a.vec_id % 100 = 0 AND r.vec_id IS DISTINCT FROM a.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id,
  positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 10
"""

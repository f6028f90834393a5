"""DuckDB twin of the conversation repair: all four states step by step, whole texts beside them."""


def _step(state: str, cost: str, letter: str, line: str) -> str:
    return (f"CASE WHEN {state} IS NOT NULL THEN {{'k': lpad(CAST(CAST(substr({state}.k, 1, 8) AS BIGINT)"
            f" + {cost} AS VARCHAR), 8, '0') || substr({state}.k, 9) || '{letter}',"
            f" 'r': {state}.r || {line}}} END")


def _least(*options: str) -> str:
    return "list_min([" + ", ".join(options) + "])"


def _new(state: str, role: str) -> str:
    return _step(state, "2", "I", f"chr(10) || '{role}:'")


_U1 = _least("u", *[_new(s, "user") for s in ("z", "s", "a")])
_A1 = _least("a", _new("u1", "assistant"))
_KEPT = "chr(10) || role || ':' || text"
_DROP = {s: _step(s, "3", "D", "''") for s in ("z", "s", "u1", "a1")}


def _stays(state: str, initial: str) -> str:
    return (f"CASE WHEN NOT gone AND initial = '{initial}' THEN "
            + _step(state, "cut", "K", _KEPT) + " END")


def _moved(state: str, role: str) -> str:
    return ("CASE WHEN NOT gone THEN "
            + _step(state, "(2 + cut)", "R", f"chr(10) || '{role}:' || text") + " END")


_BEFORE_USER = ("z", "s", "a1")
_NEXT_S = _least(_DROP["s"], _stays("z", "s"))
_NEXT_U = _least(_DROP["u1"], *[_stays(s, "u") for s in _BEFORE_USER],
                 *[_moved(s, "user") for s in _BEFORE_USER])
_NEXT_A = _least(_DROP["a1"], _stays("u1", "a"), _moved("u1", "assistant"))

TURN_REPAIR = rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
spots AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS spot
  FROM conversations),
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(spot))), lambda i:
        ('0x' || substr(hex(encode(spot)), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
      lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind
  FROM spots, crc),
broken AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS initial,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS twin,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open,
    lag(left(role, 1)) OVER w AS prior
  FROM broken WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
marked AS (
  SELECT *, blank OR twin AS gone, CAST(NOT blank AND NOT twin AND open AS INT) AS cut FROM placed),
convs AS (SELECT DISTINCT conv_id FROM conversations),
counts AS (
  SELECT conv_id, count(*) AS n,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    sum(CAST(blank AS INT)) AS blank, sum(CAST(NOT blank AND twin AS INT)) AS duplicate, sum(cut) AS truncated,
    sum(CAST(i > 1 AND prior || initial NOT IN ('su', 'ua', 'au') AS INT)) AS illegal
  FROM marked GROUP BY conv_id),
walk(conv_id, i, z, s, u, a) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'k': '00000000', 'r': ''}}, CAST(NULL AS STRUCT(k VARCHAR, r VARCHAR)),
    CAST(NULL AS STRUCT(k VARCHAR, r VARCHAR)), CAST(NULL AS STRUCT(k VARCHAR, r VARCHAR)) FROM convs
  UNION ALL
  SELECT conv_id, i, {_DROP["z"]}, {_NEXT_S}, {_NEXT_U}, {_NEXT_A}
  FROM (
    SELECT *, {_A1} AS a1 FROM (
      SELECT w.*, {_U1} AS u1 FROM (
        SELECT walk.conv_id, marked.i, z, s, u, a, role, text, initial, gone, cut
        FROM walk JOIN marked ON walk.conv_id IS NOT DISTINCT FROM marked.conv_id AND marked.i = walk.i + 1) w))),
ended AS (
  SELECT conv_id, {_least("z", "a1")} AS best FROM (
    SELECT *, {_A1} AS a1 FROM (
      SELECT e.*, {_U1} AS u1 FROM (
        SELECT walk.* FROM walk LEFT JOIN counts ON walk.conv_id IS NOT DISTINCT FROM counts.conv_id
        WHERE walk.i = coalesce(counts.n, 0)) e)))
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(substr(best.k, 1, 8) AS BIGINT) AS cost,
  substr(best.k, 9) AS audit, sha256(substr(best.r, 2)) AS repaired_sha256
FROM convs c JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN counts n ON c.conv_id IS NOT DISTINCT FROM n.conv_id
"""

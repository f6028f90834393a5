"""Temporal URL lists and the content-addressed archive on small tables."""

import base64
import datetime
import hashlib

import pytest

from ratecheck.llm import url_lists, warc_store

D = datetime.date
T = datetime.datetime
ENTRY = "list string, verdict string, kind string, key string, action string, listed_on date"


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame([
        ("spam", "block", "domain", "bad.org", "add", D(2024, 1, 10)),
        ("spam", "block", "domain", "bad.org", "add", D(2024, 1, 12)),
        ("spam", "block", "domain", "bad.org", "remove", D(2024, 2, 1)),
        ("spam", "block", "domain", "bad.org", "add", D(2024, 6, 1)),
        ("good", "allow", "prefix", "bad.org/press/2024", "add", D(2024, 1, 1)),
        ("one", "block", "url", "x.net/a?b=1", "add", D(2024, 3, 1)),
        ("both", "block", "domain", "tie.com", "add", D(2024, 3, 1)),
        ("both", "block", "domain", "tie.com", "remove", D(2024, 3, 1)),
        ("odd", "block", "planet", "bad.org", "add", D(2024, 1, 1)),
        (None, "block", "domain", "bad.org", "add", D(2024, 1, 1)),
        ("odd", "block", "domain", None, "add", D(2024, 1, 1)),
    ], ENTRY)


def test_intervals(spark, entries):
    got = {(r.list, r.key, r.since, r.until) for r in url_lists.intervals(entries).collect()}
    assert got == {
        ("spam", "bad.org", D(2024, 1, 10), D(2024, 2, 1)), ("spam", "bad.org", D(2024, 6, 1), None),
        ("good", "bad.org/press/2024", D(2024, 1, 1), None),
        ("one", "x.net/a?b=1", D(2024, 3, 1), None), ("both", "tie.com", D(2024, 3, 1), None)}


def test_captures_as_of_their_fetch_time(spark, entries):
    rows = [
        (1, "http://www.Bad.org:80/x", T(2024, 1, 9, 23, 59)), (2, "https://bad.org/", T(2024, 1, 10)),
        (3, "https://u@bad.org./p", T(2024, 1, 31, 23)), (4, "https://bad.org/p", T(2024, 2, 1)),
        (5, "https://bad.org/press/2024/a.html#x", T(2024, 7, 1)), (6, "http://x.net/a?b=1#f", T(2025, 1, 1)),
        (6, "http://x.net/a?b=1#f", T(2025, 1, 1)), (7, "/relative", T(2024, 7, 1)), (8, None, T(2024, 7, 1)),
        (None, "http://tie.com", None), (9, "http://notbad.org/", T(2024, 1, 20)),
        (None, "http://tie.com", T(2024, 3, 1)),
    ]
    captures = spark.createDataFrame(
        [(*r, "x", 0) for r in rows],
        "page_id long, url string, fetched timestamp, list string, n_active int")
    got = sorted((str(r.id), str(r.url), r.n_active, r.lists, r.verdict) for r in url_lists.judge(
        captures, url_lists.intervals(entries)).collect())
    want = {1: (0, "", None), 2: (1, "spam", "block"), 3: (1, "spam", "block"), 4: (0, "", None),
            5: (2, "good,spam", "allow"), 6: (1, "one", "block"), 7: (0, "", None), 8: (0, "", None),
            9: (0, "", None)}
    expected = [(str(i), str(u), *(want[i] if i else ((1, "both", "block") if t else (0, "", None))))
                for i, u, t in rows]
    assert got == sorted(expected)


def test_no_lists_and_no_captures(spark, entries):
    none = spark.createDataFrame([], "page_id long, url string, fetched timestamp")
    assert url_lists.judge(none, url_lists.intervals(entries)).count() == 0
    one = spark.createDataFrame([(1, "http://bad.org", T(2024, 7, 1))], none.schema)
    assert url_lists.judge(one, url_lists.intervals(entries.limit(0))).first().n_active == 0


def record_fields(content):
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1"
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block, end = rest[:int(fields["Content-Length"])], rest[int(fields["Content-Length"]):]
    assert end == b"\r\n\r\n"
    return fields, block


def test_archive_round_trip(spark):
    long = "ü" * 300_000
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, "http://c/", None),
            (4, None, ""), (5, "http://d/\r\nInjected: x", long), (7, "http://e/", "own"),
            (7, "http://e/", "own"), (None, "http://f/", "same"), (None, "http://g/", "alone")]
    pages = spark.createDataFrame([(*r, "q", 1) for r in rows],
                                  "page_id long, url string, html string, digest string, record int")
    folder = warc_store.write_archive(pages)
    got = sorted(map(tuple, warc_store.read_index(spark, folder).drop("record").collect()), key=str)
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want, seen = [], set()
    for i, _, h in rows:
        body = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = (-1 if i is None else i) == largest[h or ""] and (i, h) not in seen
        seen.add((i, h))
        want.append((i, len(body), digest, "response" if first else "revisit",
                     None if first else largest[h or ""]))
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{folder}/payloads").count() == len(largest)
    for r in warc_store.read_records(spark, folder, originals=True).collect():
        fields, block = record_fields(bytes(r.content))
        http, _, body = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK") and "Injected" not in fields
        payload = bytes(r.payload)
        assert body == (payload if fields["WARC-Type"] == "response" else b"")
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(
            hashlib.sha1(payload).digest()).decode()


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")],
                                  "page_id long, url string, html string")
    index = warc_store.read_index(spark, warc_store.write_archive(pages, least_bytes=3))
    assert {r.page_id: r.record_type for r in index.collect()} == {
        1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_spoiled_payload_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab")], "page_id long, url string, html string")
    folder = warc_store.write_archive(pages, str(tmp_path / "w"))
    stored = spark.read.parquet(f"{folder}/payloads").selectExpr("digest", "CAST('xx' AS BINARY) payload")
    other = str(tmp_path / "v")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{other}/headers")
    stored.write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc_store.read_index(spark, other).collect()


def test_empty_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc_store.read_index(spark, warc_store.write_archive(pages)).count() == 0

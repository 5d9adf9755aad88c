"""Archives must come back as they went, whatever the payloads hold."""

import base64
import hashlib

from volpanel.llm import common, warc


def expected(rows):
    by = {}
    for i, _, html in rows:
        by.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [x for x in by[html or ""] if x is not None]
        last = max(ids) if ids else None
        new = last is None or i == last
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if new else "revisit", None if new else last))
    return sorted(out, key=repr)


def test_round_trip(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    rows = [
        (1, "http://a/1", "plain"), (2, "http://a/2", "plain"), (3, None, None), (4, "u", ""), (5, "http://é\r\nX: y", "é中\r\n\r\nb"),
        (6, "u", "WARC/1.1\r\n"), (7, "u", fake), (8, "u", "x" + fake * 3 + "WARC/1.1\r\nContent-Length: nine\r\n\r\n"), (9, "u", fake),
        (10, "u", "WARC/1.1\r\n" * 5), (11, "u", "end WARC/1.1"), (None, "u", "plain"), (None, "u", "lonely"), (12, "u", "z" * 5000), (12, "u", "z" * 5000), (13, "u", "\r\n\r\n"),
    ]
    for n in range(14, 60):
        rows.append((n, "u", f"page {n} " + fake * (n % 4) + "t" * (n % 7)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = warc.archived_rows(pages, common.shared_path(spark, "archive")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_pointers_into_chains(spark):
    """A false record whose successor is a true boundary must not count."""
    tail = "\r\n\r\n"
    inner = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:77>\r\nContent-Length: 10\r\n\r\n"
    html = "a" * 30 + inner + "b" * 6  # with the blank lines behind the record, the false content ends where the next record begins
    rows = [(1, "u", html), (2, "u", "next"), (3, "u", html + tail)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert sorted(map(tuple, warc.archived_rows(pages, common.shared_path(spark, "archive")).collect()), key=repr) == expected(rows)


def test_revisits_of_one_id_with_two_payloads(spark):
    rows = [(12, "u", "first"), (12, "u", "the second one"), (12, "u", ""), (3, "u", "first"), (4, "u", "the second one"), (5, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    assert sorted(map(tuple, warc.archived_rows(pages, common.shared_path(spark, "archive")).collect()), key=repr) == expected(rows)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived_rows(pages, common.shared_path(spark, "archive")).collect() == []


def test_extra_columns_of_clashing_names(spark):
    rows = [(1, "u", "same", "x", 5, "y"), (2, "u", "same", "x", 6, "y"), (3, "u", "WARC/1.1\r\nother", "x", 7, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, refers_to int, payload string")
    got = warc.archived_rows(pages, common.shared_path(spark, "archive")).collect()
    assert sorted(map(tuple, got), key=repr) == expected([r[:3] for r in rows])


def test_one_record_over_many_splits(spark):
    """A payload of version lines longer than a split: runs and owners are carried over blocks."""
    rows = [(n, "u", f"{n} " + "WARC/1.1\r\nContent-Type: x\r\n" * (400 if n == 3 else 0) + "z" * 50 * n) for n in range(1, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1100b")
    try:
        got = warc.archived_rows(pages, common.shared_path(spark, "archive")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got), key=repr) == expected(rows)

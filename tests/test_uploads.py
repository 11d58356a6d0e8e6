"""Uploads from a folder, validation, confirmed crawls and the cache, on rows made by hand."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from marlstone.sources import files


def test_uploads_of_a_folder(spark, tmp_path):
    for name, content in (("a.PDF", b"one"), ("b.md", b"one"), ("c.exe", b"x"), ("d e%20.docx", b""), ("e", b"one"), ("f.md", b"y" * 50), ("g.md", b"known")):
        (tmp_path / name).write_bytes(content)
    found = files.uploads(spark, str(tmp_path))
    a = found.where("name = 'a.PDF'").first()
    assert (a.extension, a.n_bytes, a.checksum, a.reference) == ("pdf", 3, hashlib.sha256(b"one").hexdigest(), "manual_upload://a.PDF")
    stored = spark.createDataFrame([(hashlib.sha256(b"known").hexdigest(),), (None,)], "checksum string")
    decided = {r.name: r.decision for r in files.validated(found, stored, most_bytes=49).collect()}
    assert decided == {"a.PDF": "accepted", "b.md": "duplicate", "c.exe": "unsupported_type", "d e%20.docx": "empty", "e": "unsupported_type", "f.md": "too_large", "g.md": "duplicate"}


def test_listed_files_and_no_files(spark):
    shape = "name string, n_bytes long, checksum string"
    listed = files.described(spark.createDataFrame([("a.docx", 0, "s0"), ("b.docx", None, None), ("c.md", 5, "s1"), ("c.md", 5, "s1"), (None, 5, "s2"), ("z.md", 5, "s1")], shape))
    stored = spark.createDataFrame([], "checksum string")
    decided = sorted((r.name or "", r.decision) for r in files.validated(listed, stored).collect())
    assert decided == [("", "unsupported_type"), ("a.docx", "empty"), ("b.docx", "empty"), ("c.md", "accepted"), ("c.md", "accepted"), ("z.md", "duplicate")]
    assert files.validated(listed.limit(0), stored).count() == 0


def test_no_page_stops_a_crawl(spark):
    pages = spark.createDataFrame([(1, "https://x.org/", "<p>"), (2, None, "<p>"), (3, "mailto:a@b", "<p>"), (4, "HTTP://x.org", None), (5, "http://x.org", " ")], "page_id int, url string, html string")
    crawled = files.confirmed(pages)
    assert {r.page_id: r.error for r in crawled.collect()} == {1: None, 2: "bad_url", 3: "bad_url", 4: "empty_page", 5: "empty_page"}
    assert [r.page_id for r in files.without_errors(crawled).collect()] == [1]


def test_cache_keeps_ten_minutes(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = [(1, "old", now - dt.timedelta(seconds=601)), (2, "edge", now - dt.timedelta(seconds=600)), (3, "first", now - dt.timedelta(seconds=90)), (3, "second", now - dt.timedelta(seconds=30)), (4, None, None)]
    cache = spark.createDataFrame(rows, "user_id int, payload string, stored_at timestamp")
    assert {r.user_id: r.payload for r in files.live_discoveries(cache, F.lit(now)).collect()} == {2: "edge", 3: "second"}

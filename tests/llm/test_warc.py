"""WARC derivatives against parsers of the standard library, and files that are written and read again."""

import base64
import email
import gzip
import hashlib
import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tessera.llm.queries import QUERIES
from tessera.llm.warc import build, derivatives, derive, read_records, response_records, split_records, unpacked, write_derivatives

SCHEMA = "page_id bigint, url string, html string, record string, record_id int"


def taken_apart(record):
    """Version line, headers with the standard library's parser, and block."""
    head, _, block = record.partition(b"\r\n\r\n")
    version, _, fields = head.partition(b"\r\n")
    return version, email.message_from_bytes(fields + b"\r\n\r\n"), block


def digest(block):
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


class Words(HTMLParser):
    """Visible words of a page."""

    def __init__(self):
        super().__init__()
        self.deaf, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.deaf += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.deaf -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.deaf:
            self.words += data.split()


def pages():
    dice = random.Random(2)
    made = [(k, f"http://a{k % 7}.org/{k}", f"<html><head><title>T &amp; {k}</title><style>p {{}}</style></head><body><h1>Head {k}</h1><p>One <a href='/x'>two</a> &lt;three&gt; é</p><script>var a = 1;</script><p>{dice.random()}</p></body></html>") for k in range(40)]
    return made + [(50, None, "<p>no url</p>"), (51, "http://b.org", None), (52, "http://b.org", ""), (53, "http://c.org/\r\nX: y", "<p>x"), (None, "http://d.org", "<p>none</p>"), (54, "http://e.org", "<p>" + "long text " * 60_000 + "</p>")]


def test_derivatives_of_pages(spark):
    rows = [(*p, "x", 1) for p in pages()]
    found = derive(response_records(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(found) == 2 * len(rows)
    by = {(r.page_id, r.record_type): r for r in found}
    ids = [r.record_id for r in found]
    assert len(set(ids)) == len(ids)
    for page, url, html in pages():
        body = (html or "").encode()
        about, text = by[page, "metadata"], by[page, "conversion"]
        assert about.refers_to == text.refers_to and about.refers_to not in ids
        for row, kind in ((about, "metadata"), (text, "conversion")):
            version, headers, block = taken_apart(bytes(row.record))
            assert version == b"WARC/1.1" and headers["WARC-Type"] == kind and headers["WARC-Record-ID"] == row.record_id
            assert headers["WARC-Refers-To"] == row.refers_to and int(headers["Content-Length"]) == len(block) == row.content_length
            assert headers["WARC-Block-Digest"] == digest(block) == row.block_digest and row.source_digest == digest(body)
            assert headers["WARC-Target-URI"] == (" ".join(url.split("\r\n")) if url else None)
        fields = email.message_from_bytes(taken_apart(bytes(about.record))[2])
        assert fields["source-warc-record-id"] == about.refers_to and fields["payload-digest-computed"] == digest(body)
        assert fields["payload-digest-agrees"] == "true" and int(fields["payload-length"]) == len(body) and fields["http-status"] == "HTTP/1.1 200 OK"
        words = Words()
        words.feed(html or "")
        assert taken_apart(bytes(text.record))[2].decode().split() == words.words
    assert derive(response_records(spark.createDataFrame([], SCHEMA))).count() == 0


def test_pages_that_differ_in_content_only_have_their_own_ids(spark):
    rows = [(1, "http://a.org", "one", "", 0), (1, "http://a.org", "two", "", 0), (1, "http://a.org", "two", "", 0)]
    found = derive(response_records(spark.createDataFrame(rows, SCHEMA)))
    assert found.count() == 6 and found.select("record_id").distinct().count() == 4


def test_repeated_and_folded_headers_stay():
    body = gzip.compress("<p>zipped é</p>".encode("latin-1"))
    block = b"HTTP/1.1 404 Not Found\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nX-Long: one\r\n two\r\nContent-Encoding: gzip\r\nContent-Type: text/html; charset=latin-1\r\n\r\n" + body
    record = build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Concurrent-To", "<urn:y>"), ("WARC-Concurrent-To", "<urn:z>"), ("WARC-Date", "2024"), ("WARC-Payload-Digest", "sha1:WRONG")], block)
    about, text = derivatives(1, record)
    fields = email.message_from_bytes(taken_apart(about[-1])[2])
    assert fields.get_all("http-set-cookie") == ["a=1", "b=2"] and fields.get_all("source-warc-concurrent-to") == ["<urn:y>", "<urn:z>"]
    assert fields["http-x-long"] == "one two" and fields["payload-digest-agrees"] == "false" and fields["content-state"] == "decoded"
    assert taken_apart(text[-1])[2].decode() == "zipped é"
    assert derivatives(1, record.replace(b"response\r\nWARC-Record", b"request\r\nWARC-Record")) == []


def test_files_are_read_as_written(spark, tmp_path):
    made = derive(response_records(spark.createDataFrame([(*p, "", 0) for p in pages()], SCHEMA)))
    write_derivatives(made, str(tmp_path / "out"))
    assert sorted(bytes(r.record) for r in read_records(spark, str(tmp_path / "out")).collect()) == sorted(bytes(r.record) for r in made.collect())
    # members of their own, one large, and a file that is not zipped
    records = [build([("WARC-Type", "metadata")], b"x" * n) for n in (0, 5, 3_000_000, 1 << 20)]
    plain = b"".join(r + b"\r\n\r\n" for r in records)
    assert list(split_records(unpacked(plain))) == records
    assert list(split_records(unpacked(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records)))) == records


def test_query(spark):
    found = QUERIES["op10_warc"](spark, "/root/testdata/sf0.001")
    assert found.count() == 2 * spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert found.where(F.col("page_id").isNull() | F.col("record_sha256").isNull()).count() == 0

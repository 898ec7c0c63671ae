"""WARC derivatives: a metadata and a plain-text conversion record for every response record.

``response_records`` wraps pages as WARC/1.1 responses. ``derive`` parses responses and builds, for each, one ``metadata``
record (all of the source's headers and HTTP headers in their order, repeated ones too, folded lines joined; HTTP status,
digests, lengths, title and links counted) and one ``conversion`` record (the page's text). Both point to the response by ``WARC-Refers-To``, keep its target URI and date, and carry a
SHA-1 block digest of their own; the metadata record repeats the response's payload digest, and whether the payload
still has it. ``write_derivatives`` writes them as WARC files and ``read_records`` reads such files again.

Records are independent, so everything is one pass without a shuffle; record ids are name-based UUIDs of what they are
made from, payload included, so a task that runs again writes the same records and different pages have different ids.

Defined results: a null html is an empty payload; a null url leaves out ``WARC-Target-URI``. A record that is no response
has no derivatives. A payload with a bad Content-Encoding is taken as it is, and its metadata says ``truncated-or-raw``.
Bytes that are no text in the declared charset become replacement characters in the conversion only. Repeated rows give
repeated records (with equal ids). An empty table gives none. Extra columns are not read. ``read_records`` takes files of
up to 2 GB as they are stored; what they unpack to may be of any size, one record at a time in memory.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html as html_entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = b"\r\n"
DERIVED = "page_id bigint, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length bigint, block_digest string, source_digest string, record binary"

# Every pattern takes an unclosed construct to the end of the text, so that no place is scanned twice.
HIDDEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(script|style|noscript|template)\b[^>]*(?:>(?:.*?</\1\s*>|.*\Z)|\Z)", re.S | re.I)
BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*(?:>|\Z)", re.I)
TAG = re.compile(r"<[a-zA-Z/!?][^>]*(?:>|\Z)")
TITLE = re.compile(r"<title\b[^>]*>([^<]*)", re.I)
LINK = re.compile(r"<a\s[^>]*?href\s*=", re.I)
BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")


def sha1(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*names: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, names)))}>"


def one_line(value: str) -> str:
    """A header value cannot hold line ends."""
    return re.sub(r"[\r\n]+", " ", value).strip()


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    head = "".join(f"{k}: {one_line(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block


Fields = list[tuple[str, str]]


def parse(record: bytes) -> tuple[Fields, bytes]:
    """Headers, by lower-case name and in their order, and block of one record."""
    head, gap, rest = record.partition(CRLF + CRLF)
    first, _, fields = head.partition(CRLF)
    if not first.startswith(b"WARC/") or not gap:
        raise ValueError("not a WARC record")
    headers = parse_fields(fields)
    return headers, rest[: int(value_of(headers, "content-length", "0"))]


def parse_fields(fields: bytes) -> Fields:
    """Names and values of all header lines; a line that starts with a blank goes on with the value before it."""
    out: Fields = []
    for line in fields.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if line[:1] in (" ", "\t"):
            if out:
                out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif colon:
            out.append((name.strip().lower(), value.strip()))
    return out


def value_of(fields: Fields, name: str, default: str | None = None) -> str | None:
    """The first value of a header."""
    return next((v for k, v in fields if k == name), default)


def payload_of(block: bytes) -> tuple[str, Fields, bytes]:
    """Status line, headers and body of an HTTP response."""
    head, _, body = block.partition(CRLF + CRLF)
    status, _, fields = head.partition(CRLF)
    return status.decode("latin-1"), parse_fields(fields), body


def decoded(body: bytes, http: Fields) -> tuple[str, bool]:
    """The body as text, and whether its content encoding could be undone."""
    coding, good = value_of(http, "content-encoding", "identity").lower(), True
    try:
        if coding in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif coding == "deflate":
            body = zlib.decompress(body)
        elif coding != "identity":
            good = False
    except (OSError, EOFError, zlib.error):
        good = False
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", value_of(http, "content-type", ""))
    try:
        charset = codecs.lookup(named[1]).name if named else "utf-8"
        return body.decode(charset, "replace"), good
    except (LookupError, UnicodeError, ValueError):
        return body.decode("utf-8", "replace"), good


def plain_text(page: str) -> str:
    """Visible text: blocks on lines of their own, blanks collapsed, entities resolved."""
    page = HIDDEN.sub(" ", page).replace("\n", " ")
    page = html_entities.unescape(TAG.sub("", BREAK.sub("\n", page)))
    lines = (BLANKS.sub(" ", line).strip() for line in page.split("\n"))
    return "\n".join(line for line in lines if line)


def response_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``page_id, record``: a WARC response for every row of ``pages(page_id, url, html)``."""

    def wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            records = []
            for page, url, body in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                body = (body or "").encode("utf-8", "surrogatepass")
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                target = [("WARC-Target-URI", url)] if url else []
                headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page, url, sha1(body))), ("WARC-Date", date), *target]
                headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1(body)), ("WARC-Block-Digest", sha1(block))]
                records.append(build(headers, block))
            yield pd.DataFrame({"page_id": batch["page_id"], "record": records})

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInPandas(wrap, "page_id bigint, record binary")


def derivatives(page: int | None, record: bytes) -> list[tuple]:
    """Rows of DERIVED for one record: its metadata and its conversion."""
    headers, block = parse(record)
    if value_of(headers, "warc-type") != "response":
        return []
    status, http, body = payload_of(block)
    source, target, date = value_of(headers, "warc-record-id", ""), value_of(headers, "warc-target-uri"), value_of(headers, "warc-date", "")
    digest = value_of(headers, "warc-payload-digest", "")
    markup, good = decoded(body, http)
    text = plain_text(markup).encode("utf-8", "surrogatepass")
    title = TITLE.search(markup)
    fields = [(f"source-{k}", v) for k, v in headers if k != "content-length"]
    fields += [("http-status", status), *((f"http-{k}", v) for k, v in http)]
    fields += [("payload-digest-computed", sha1(body)), ("payload-digest-agrees", str(sha1(body) == digest).lower())]
    fields += [("payload-length", str(len(body))), ("content-state", "decoded" if good else "truncated-or-raw")]
    fields += [("title", html_entities.unescape(title[1]) if title else ""), ("links", str(len(LINK.findall(markup))))]
    described = "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields).encode("utf-8", "replace")
    out = []
    for kind, mime, made in (("metadata", "application/warc-fields", described), ("conversion", "text/plain; charset=utf-8", text)):
        own, check = record_id(kind, source), sha1(made)
        about = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Date", date)]
        about += [("WARC-Target-URI", target)] if target else []
        about += [("WARC-Block-Digest", check), ("Content-Type", mime)]
        out.append((page, kind, own, source, target, date, mime, len(made), check, digest, build(about, made)))
    return out


def derive(responses: DataFrame) -> DataFrame:
    """Rows of DERIVED for all ``responses(page_id, record)``."""
    names = [f.split()[0] for f in DERIVED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                rows = [row for page, record in zip(part["page_id"], part["record"], strict=True) for row in derivatives(page, bytes(record))]
                yield pd.DataFrame(rows, columns=names)

    return responses.select("page_id", "record").mapInPandas(run, DERIVED)


def write_derivatives(records: DataFrame, path: str) -> None:
    """WARC files, gzipped: both kinds of derivatives are UTF-8, and the text writer puts the closing line ends."""
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


#: Bytes that are unpacked at once, and bytes of records in a batch.
PIECE, BATCH = 1 << 20, 1 << 24


def unpacked(stored: bytes) -> Iterator[bytes]:
    """A file's bytes in pieces; gzip members one after the other."""
    if stored[:2] != b"\x1f\x8b":
        for at in range(0, len(stored), PIECE):
            yield stored[at : at + PIECE]
        return
    at, unzip = 0, zlib.decompressobj(31)
    while at < len(stored):
        piece = stored[at : at + PIECE]
        at += len(piece)
        while piece:
            out = unzip.decompress(piece, PIECE)
            if out:
                yield out
            if unzip.eof:
                piece, unzip = unzip.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
            else:
                piece = unzip.unconsumed_tail
                if not piece and len(out) == PIECE:  # what is still inside
                    while out := unzip.decompress(b"", PIECE):
                        yield out


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of one WARC file, by their declared lengths."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while True:
            gap = held.find(CRLF + CRLF)
            if gap < 0:
                break
            end = gap + 4 + int(value_of(parse_fields(bytes(held[:gap])), "content-length", "0"))
            if len(held) < end + 4:
                break
            yield bytes(held[:end])
            del held[: end + 4]
    if held.strip():
        raise ValueError("the file ends inside a record")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``record`` for every record of the WARC files, gzipped or not, below ``path``; a task reads a file at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                records, size = [], 0
                for record in split_records(unpacked(bytes(content))):
                    records.append(record)
                    size += len(record)
                    if size > BATCH:
                        yield pd.DataFrame({"record": records})
                        records, size = [], 0
                yield pd.DataFrame({"record": records})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "record binary")

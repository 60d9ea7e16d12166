"""WARC derivatives: response records to linked metadata and conversion records.

Each response gives a metadata record (JSON: the source's WARC and HTTP headers, lengths,
digests, title and links) and a conversion record (the page's plain text). Both name the
response in WARC-Refers-To, with its target, date and digests, and have digests of their
own; their identifiers follow from the response's, so a task that runs again writes the
same records.

``read`` takes records from WARC files (plain, or gzip members), ``derive_all`` derives from
such records, ``build`` from a table of pages, for which it makes the response first; pages
have no date, so their records carry the one given.

Defined cases: a null or empty payload gives a metadata record without title and links and
an empty conversion; a null address leaves the target header out; of repeated headers the
first counts, and all are in the metadata; a payload is decoded by its Content-Encoding and
charset, and taken as it is where those are wrong or unknown; a file that breaks off gives
the records so far, the last one marked WARC-Truncated; a record without Content-Length goes
on to the next record; repeated rows give equal records with equal identifiers; extra
columns pass by.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecairn.llm import extract
from lakecairn.llm import textkernel as K

VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("5b1f3c1e-6f0e-5b0f-9d0a-2f3c4d5e6f70")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.I | re.S)
_LINK = re.compile(r"<a\s[^>]*?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<script\b.*?(?:</script\s*>|\Z)", re.I | re.S)

Headers = list[tuple[str, str]]


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def digest(data: bytes) -> str:
    """The digest form that WARC tools write: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_bytes(headers: Headers) -> bytes:
    """A record's header as it stands in a file, with the empty line that ends it."""
    return "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in headers), "", ""]).encode()


def record_bytes(headers: Headers, block: bytes) -> bytes:
    """A record as it stands in a file, Content-Length last."""
    return header_bytes([*headers, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def first(headers: Headers, name: str) -> str | None:
    """The first header of that name, in any case of letters."""
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def unzipped(data: bytes) -> bytes:
    """The bytes of all gzip members, as far as they go."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data) + member.flush())
        except zlib.error:
            break
        if not member.eof:
            break
        data = member.unused_data
    return b"".join(out)


_RECORD = re.compile(rb"WARC/\d")


def read_records(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """(headers, block) of each record of a file, plain or of gzip members."""
    if data[:2] == b"\x1f\x8b":
        data = unzipped(data)
    at = 0
    while (begin := _RECORD.search(data, at)) is not None:
        at = begin.start()
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return  # broken off in a header
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
        size = first(headers, "Content-Length")
        if size is None or not size.isdigit():
            after = re.compile(rb"\r\n\r\nWARC/\d").search(data, end + 2)
            stop = after.start() if after else len(data)
            yield headers, data[end + 4 : max(end + 4, stop)]
            at = max(end + 4, stop)
            continue
        at = end + 4 + int(size)
        if at > len(data):
            headers.append(("WARC-Truncated", "unspecified"))
        yield headers, data[end + 4 : at]


def one_line(text: str) -> str:
    """A header's value: no line ends."""
    return re.sub(r"[\r\n]+", " ", text)


def response(url: str | None, payload: bytes, date: str = DATE) -> tuple[Headers, bytes]:
    """A response record of a fetched page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url or "", date, hashlib.sha256(payload).hexdigest())), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", one_line(url)))
    headers += [("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return headers, block


def split_http(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def decoded(http: Headers, payload: bytes) -> str:
    """The payload as text, by its Content-Encoding and charset."""
    for coding in reversed((first(http, "Content-Encoding") or "").lower().replace(" ", "").split(",")):
        if coding in ("gzip", "x-gzip", "deflate"):
            try:
                payload = zlib.decompressobj(47 if payload[:2] == b"\x1f\x8b" or payload[:1] == b"x" else -15).decompress(payload)
            except zlib.error:
                break
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", first(http, "Content-Type") or "", re.I)
    try:
        name = codecs.lookup(named[1]).name if named else "utf-8"
        return payload.decode(name, "replace")
    except (LookupError, UnicodeError):
        return payload.decode("utf-8", "replace")


def derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The metadata record and the conversion record of a response."""
    return [(own, data) for own, data, _ in _derive(headers, block)]


def _derive(headers: Headers, block: bytes) -> list[tuple[Headers, bytes, int]]:
    """derive(), and the number of links that each lists."""
    status, http, payload = split_http(block)
    page = decoded(http, payload)
    title = _TITLE.search(page)
    links = [html.unescape(x.strip("\"'")) for x in _LINK.findall(_COMMENT.sub("", page))]
    source = first(headers, "WARC-Record-ID") or record_id("unnamed", hashlib.sha256(block).hexdigest())
    target, date, whole = (first(headers, k) for k in ("WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest"))
    refers = [("WARC-Refers-To", source)]
    refers += [(k, v) for k, v in (("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date)) if v is not None]
    kept = [h for h in headers if h[0].lower() != "content-length"]
    envelope = {
        "Envelope": {
            "WARC-Header-Metadata": headers,
            "WARC-Header-Length": len(header_bytes([*kept, ("Content-Length", str(len(block)))])),
            "Block-Digest": first(headers, "WARC-Block-Digest"),
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": status,
                    "Headers": http,
                    "Entity-Length": len(payload),
                    "Entity-Digest": whole or digest(payload),
                    "HTML-Metadata": {"Title": extract._SPACE.sub(" ", html.unescape(title[1])).strip() if title else None, "Links": links},
                }
            },
        }
    }
    text = "\n".join(b.text for b in extract.blocks(page)).encode()
    out = []
    for kind, content, data, n_links in (("metadata", "application/json", json.dumps(envelope, ensure_ascii=False, separators=(",", ":")).encode(), len(links)), ("conversion", "text/plain; charset=utf-8", text, 0)):
        own = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)), ("WARC-Date", date or DATE)]
        own += [("WARC-Target-URI", target)] if target is not None else []
        own += refers
        own += [("WARC-Source-Payload-Digest", whole)] if whole is not None else []
        out.append(([*own, ("WARC-Block-Digest", digest(data)), ("Content-Type", content)], data, n_links))
    return out


RECORDS = (
    "page_id long, url string, kind string, record_id string, refers_to string, target_uri string, warc_date string, "
    "source_payload_digest string, source_block_digest string, block_digest string, n_bytes long, n_links long, record_sha256 string, record binary"
)


_KINDS = pa.schema([(n, pa.binary() if n == "record" else pa.int64() if n in ("page_id", "n_bytes", "n_links") else pa.string()) for n in (x.split()[0] for x in RECORDS.split(", "))])


def _derived(sources: list[tuple[int | None, str | None, Headers, bytes]], records: bool) -> pa.RecordBatch:
    """Rows of both derivatives of each (id, address, headers, block)."""
    rows = []
    for page_id, url, headers, block in sources:
        for own, data, n_links in _derive(headers, block):
            whole = record_bytes(own, data)
            named = [first(own, k) for k in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date")]
            digests = [first(headers, "WARC-Payload-Digest"), first(headers, "WARC-Block-Digest"), first(own, "WARC-Block-Digest")]
            rows.append((page_id, url, *named, *digests, len(data), n_links, hashlib.sha256(whole).hexdigest(), whole if records else None))
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_KINDS), _KINDS.types)], schema=_KINDS)


def build(pages: DataFrame, records: bool = True, date: str = DATE) -> DataFrame:
    """Both derived records of every page's response; ``records`` False leaves their bytes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")))
                yield _derived([(i, url, *response(url, (page or "").encode(), date)) for i, url, page in rows], records)

    out = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(K.tidy(run), RECORDS)
    return out if records else out.drop("record")


READ = "path string, pos long, kind string, record_id string, target_uri string, warc_date string, headers array<struct<name: string, value: string>>, block binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, by Spark's own file reader (so files up to 2 GB): one row a record, pos counts from 0 in its file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
        names = [x.split()[0] for x in READ.split(", ") if not x.startswith("value")]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), kinds, pa.binary()]
        for batch in batches:
            for k in range(batch.num_rows):
                where, rows, size = batch.column("path")[k].as_py(), [], 0
                for pos, (headers, block) in enumerate(read_records(batch.column("content")[k].as_py())):
                    named = [first(headers, x) for x in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date")]
                    rows.append((where, pos, *named, [{"name": a, "value": b} for a, b in headers], block))
                    size += len(block)
                    if size > K.MAX_BYTES:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return files.mapInArrow(K.tidy(run), READ)


def derive_all(read_: DataFrame, records: bool = True) -> DataFrame:
    """Both derived records of every response among records as ``read`` gives them; page_id is the record's place in its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = zip(*(part.column(c).to_pylist() for c in ("pos", "target_uri", "headers", "block")))
                yield _derived([(pos, uri, [(h["name"], h["value"]) for h in headers], block or b"") for pos, uri, headers, block in rows], records)

    out = read_.filter("kind = 'response'").select("pos", "target_uri", "headers", "block").mapInArrow(K.tidy(run), RECORDS)
    return out if records else out.drop("record")

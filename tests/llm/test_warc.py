from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import zlib

from lakecairn.llm import registry, warc
from tests.conftest import SF


def test_round_trip_and_links_between_records():
    page = b'<html><title>T &amp;\n t</title><!-- <a href="no"> --><body><a href="/x?a=1&amp;b=2">x</a><p>One &eacute;\n two.</p></body></html>'
    headers, block = warc.response("http://a.example/", page, "2020-01-02T03:04:05Z")
    derived = warc.derive(headers, block)
    data = b"".join(gzip.compress(warc.record_bytes(h, b)) for h, b in [(headers, block), *derived])
    back = list(warc.read_records(data))
    assert [b for _, b in back] == [block, *(b for _, b in derived)]
    source, meta, text = (dict(h) for h, _ in back)
    for own, (_, b) in ((meta, back[1]), (text, back[2])):
        assert own["WARC-Refers-To"] == source["WARC-Record-ID"] != own["WARC-Record-ID"]
        assert own["WARC-Refers-To-Target-URI"] == own["WARC-Target-URI"] == "http://a.example/"
        assert own["WARC-Refers-To-Date"] == source["WARC-Date"] == "2020-01-02T03:04:05Z"
        assert own["WARC-Source-Payload-Digest"] == warc.digest(page) and own["WARC-Block-Digest"] == warc.digest(b)
    inner = json.loads(back[1][1])["Envelope"]
    assert [tuple(x) for x in inner["WARC-Header-Metadata"]] == headers
    found = inner["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert found["HTML-Metadata"] == {"Title": "T & t", "Links": ["/x?a=1&b=2"]}
    assert dict(map(tuple, found["Headers"]))["Content-Length"] == str(len(page)) and found["Entity-Digest"] == warc.digest(page)
    assert back[2][1].decode() == "x One é two." or back[2][1].decode() == "x\nOne é two."
    assert warc.derive(headers, block) == derived


def test_query(spark):
    rows = registry.op9_warc(spark, SF).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        source = dict(warc.response(pages[r.page_id].url, pages[r.page_id].html.encode())[0])
        assert (r.refers_to, r.target_uri, r.source_payload_digest) == (source["WARC-Record-ID"], pages[r.page_id].url, source["WARC-Payload-Digest"])


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (2, "u\r\nX: y", "", "x"), (2, "u\r\nX: y", "", "x"), (3, "u", "<title>a", "x"), (4, "u", "<p>" + "long " * 100000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    out = warc.build(df).collect()
    assert len(out) == 10
    for r in out:
        ((headers, block),) = warc.read_records(bytes(r.record))
        assert dict(headers)["WARC-Record-ID"] == r.record_id and len(block) == r.n_bytes
    assert len({r.record_id for r in out}) == 8
    assert warc.build(df.limit(0)).count() == 0


def test_query_returns_the_records(spark):
    for r in registry.op9_warc(spark, SF).collect():
        ((headers, block),) = warc.read_records(bytes(r.record))
        assert dict(headers)["WARC-Record-ID"] == r.record_id and len(block) == r.n_bytes
        assert hashlib.sha256(bytes(r.record)).hexdigest() == r.record_sha256


def test_query_equals_records_written_out_by_hand(spark):
    """Text, JSON and digests of every record, from the pages alone."""
    sha1 = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = registry.op9_warc(spark, SF).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        page = pages[r.page_id].html
        body = page.encode()
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        head, data = bytes(r.record).split(b"\r\n\r\n", 1)
        own = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        data = data[: int(own["Content-Length"])]
        assert bytes(r.record) == head + b"\r\n\r\n" + data + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        assert own["WARC-Block-Digest"] == r.block_digest == sha1(data)
        assert own["WARC-Source-Payload-Digest"] == r.source_payload_digest == sha1(body) and r.source_block_digest == sha1(http + body)
        assert own["WARC-Refers-To"] == r.refers_to and own["WARC-Target-URI"] == own["WARC-Refers-To-Target-URI"] == pages[r.page_id].url
        plain = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", "", page)
        if r.kind == "metadata":
            found = json.loads(data)["Envelope"]
            source = [("WARC-Type", "response"), ("WARC-Record-ID", r.refers_to), ("WARC-Date", r.warc_date), ("WARC-Target-URI", pages[r.page_id].url), ("WARC-Payload-Digest", sha1(body)), ("WARC-Block-Digest", sha1(http + body)), ("Content-Type", "application/http; msgtype=response")]
            assert [tuple(x) for x in found["WARC-Header-Metadata"]] == source
            lines = "".join(f"{k}: {v}\r\n" for k, v in source)
            assert found["WARC-Header-Length"] == len(f"WARC/1.1\r\n{lines}Content-Length: {len(http + body)}\r\n\r\n".encode())
            links = [html.unescape(x) for x in re.findall(r'<a href="([^"]*)"', plain)]
            title = re.search(r"(?s)<title>(.*?)</title>", page)[1]
            inner = found["Payload-Metadata"]["HTTP-Response-Metadata"]
            assert inner["HTML-Metadata"] == {"Title": re.sub(r"\s+", " ", html.unescape(title)).strip(), "Links": links} and len(links) == r.n_links
            assert (inner["Response-Message"], inner["Entity-Length"], inner["Entity-Digest"]) == ("HTTP/1.1 200 OK", len(body), sha1(body))
        else:
            words = html.unescape(re.sub(r"<[^>]*>", " ", plain)).split()
            assert "".join(data.decode().split()) == "".join(words)


def test_files(spark, tmp_path):
    """Plain and zipped files, charsets, encodings, repeated headers, records cut off or without a length."""
    page = "<html><title>é</title><p>Größe, is ok.</p></html>"
    kinds = [("text/html; charset=iso-8859-1", "", page.encode("latin-1")), ("text/html", "gzip", gzip.compress(page.encode())), ("text/html; charset=utf-8", "deflate", zlib.compress(page.encode())), ("text/html; charset=nonsense", "", page.encode())]
    sources = []
    for k, (kind, coding, payload) in enumerate(kinds):
        http = f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n" + (f"Content-Encoding: {coding}\r\n" if coding else "") + "Set-Cookie: a\r\nSet-Cookie: b\r\n\r\n"
        sources.append(([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{k}>"), ("WARC-Date", "2021-05-06T07:08:09Z"), ("WARC-Target-URI", f"http://x/{k}"), ("X", "1"), ("X", "2")], http.encode() + payload))
    whole = b"".join(warc.record_bytes(h, b) for h, b in sources)
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.record_bytes(h, b)) for h, b in sources))
    read = warc.read(spark, str(tmp_path))
    assert read.count() == 8 and {r.warc_date for r in read.collect()} == {"2021-05-06T07:08:09Z"}
    out = warc.derive_all(read).collect()
    assert len(out) == 16 and len({r.record_id for r in out}) == 8
    for r in out:
        ((_, data),) = warc.read_records(bytes(r.record))
        assert r.refers_to == f"<urn:uuid:{r.page_id}>" and r.warc_date == "2021-05-06T07:08:09Z"
        if r.kind == "conversion":
            assert data.decode() == "Größe, is ok."
        else:
            found = json.loads(data)["Envelope"]
            assert [x for x in found["WARC-Header-Metadata"] if x[0] == "X"] == [["X", "1"], ["X", "2"]]
            assert [x[1] for x in found["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"] if x[0] == "Set-Cookie"] == ["a", "b"]
            assert found["WARC-Header-Length"] == len(warc.record_bytes(*sources[r.page_id])) - len(sources[r.page_id][1]) - 4
    for cut in range(0, len(whole), 37):  # broken off anywhere
        back = list(warc.read_records(whole[:cut]))
        assert len(back) <= 4 and [b for h, b in back if "WARC-Truncated" not in dict(h)] == [b for _, b in sources[: len(back)]][: len([1 for h, _ in back if "WARC-Truncated" not in dict(h)])]
    zipped = (tmp_path / "b.warc.gz").read_bytes()
    assert len(list(warc.read_records(zipped[:-9]))) == 4 and list(warc.read_records(b"")) == list(warc.read_records(b"no record")) == []
    bare = whole.replace(b"Content-Length", b"Other-Length")
    assert [b for _, b in warc.read_records(bare)][:3] == [b for _, b in sources][:3]

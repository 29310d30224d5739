"""WARC records that this library did not make, and derivatives against values worked out by hand."""

import base64
import gzip
import hashlib
import zlib

import pytest

from quiltlens.llm import warc


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def response(body, http="Content-Type: text/html", head="warc-type: Response\r\nWARC-record-ID: <urn:x:1>\r\nwarc-target-uri: <http://h/p>\r\nWarc-Date: 2020-02-02T00:00:00Z", line="\r\n"):
    block = f"HTTP/1.1 200 OK{line}{http}{line}{line}".replace("\r\n", line).encode() + body
    return (f"WARC/1.1\r\n{head}\r\nCONTENT-length: {len(block)}\r\n\r\n").replace("\r\n", line).encode() + block + (line * 2).encode()


PAGE = "<html><head><title>Café &amp; bar</title></head><body><p>Crème</p><a href='/x'>x</a></body></html>"


def chunked(body, n=7):
    return b"".join(b"%x;a=b\r\n%s\r\n" % (len(body[i:i + n]), body[i:i + n]) for i in range(0, len(body), n)) + b"0\r\n\r\n"


@pytest.mark.parametrize("body, http", [
    (PAGE.encode(), "Content-Type: text/html; charset=UTF-8"),
    (PAGE.encode("latin-1"), "content-type: text/html; charset=ISO-8859-1"),
    (PAGE.replace("<head>", "<head><meta charset='windows-1252'>").encode("cp1252"), "Content-Type: text/html"),
    (gzip.compress(PAGE.encode()), "Content-Encoding: gzip"),
    (zlib.compress(PAGE.encode()), "Content-Encoding: deflate"),
    (chunked(PAGE.encode()), "Transfer-Encoding: chunked"),
    (chunked(gzip.compress(PAGE.encode())), "Transfer-Encoding: Chunked\r\nContent-Encoding: x-gzip"),
    (PAGE.encode(), "Content-Type: text/html; charset=no-such"),
])
@pytest.mark.parametrize("line", ["\r\n", "\n"])
def test_foreign_responses(body, http, line):
    meta, text = warc.derive_one(response(body, http, line=line))
    assert (meta["kind"], text["kind"], text["refers_to"], text["target_uri"], text["n_links"]) == ("metadata", "conversion", "<urn:x:1>", "http://h/p", 1)
    (head, block), = warc.parse_records(text["record"])
    assert block.decode() == "Crème\nx" and head["warc-refers-to"] == "<urn:x:1>" and head["warc-refers-to-date"] == "2020-02-02T00:00:00Z"
    (_, fields), = warc.parse_records(meta["record"])
    told = fields.decode().split("\r\n")
    assert "title: Café & bar" in told and "outlink: /x" in told and "digest-verified: true" in told


def test_digests_and_ids():
    raw, payload = chunked(PAGE.encode()), PAGE.encode()
    base = "WARC-Type: response\r\nWARC-Target-URI: http://h/"
    for told, want in ((sha(payload), "true"), (sha(raw), "true"), (sha(b"else"), "false")):
        meta, text = warc.derive_one(response(raw, "Transfer-Encoding: chunked", f"{base}\r\nWARC-Payload-Digest: {told}"))
        assert f"digest-verified: {want}\r\n".encode() in meta["record"] and meta["source_digest"] == sha(payload)
        assert text["refers_to"].startswith("<urn:uuid:") and meta["refers_to"] == text["refers_to"]
    folded = response(b"<p>a</p>", "X-Long: one\r\n two\r\n\tthree")
    assert b"source-header-x-long: one two three\r\n" in warc.derive_one(folded)[0]["record"]


def test_bad_records_give_rows_not_failures(spark):
    ok = response(PAGE.encode())
    bad = [b"no record", ok[:-30], ok.replace(b"CONTENT-length", b"Other"), response(b"5\r\nab", "Transfer-Encoding: chunked"), response(b"zz\r\nab", "Transfer-Encoding: chunked"), response(b"not packed", "Content-Encoding: gzip")]
    rows = [(0, ok, "a"), (1, None, "b"), (2, ok + ok.replace(b"Response", b"request") + ok, "c"), (3, b"", "d"), *[(10 + i, b, "e") for i, b in enumerate(bad)]]
    df = spark.createDataFrame(rows, "page_id long, response binary, error string")
    got = {}
    for r in warc.derive(df).collect():
        got.setdefault(r.page_id, []).append((r.kind, r.error is None, r.record is None))
    pair = [("conversion", True, False), ("metadata", True, False)]
    assert {k: sorted(v) for k, v in got.items()} == {0: pair, 2: sorted(pair * 2), **{10 + i: [("error", False, True)] for i in range(len(bad))}}

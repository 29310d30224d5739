"""WARC derivative builder: responses to linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, functions as F

LINE = b"\r\n"
DATE = "2024-01-01T00:00:00Z"

_DROPPED = re.compile(r"<!--.*?-->|<(script|style|noscript|template|head)\b[^>]*>.*?(</\1\s*>|\Z)", re.I | re.S)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_BLOCK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|main|pre|blockquote|hr)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/a-zA-Z?][^>]*>")
_SPACES, _LINES = re.compile(r"[ \t\r\f\v\xa0]+"), re.compile(r" ?\n[ \n]*")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same id for the same content on every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return head.encode() + LINE + block + LINE + LINE


class Fields(dict):
    """Named fields that are found by their names in any case."""

    def __init__(self, pairs):
        super().__init__((k.lower(), v) for k, v in pairs)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def __contains__(self, name) -> bool:
        return super().__contains__(name.lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)


def _fields(lines: list[str]) -> list[tuple[str, str]]:
    """Named fields; a line that begins with white space goes on with the one before it."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def _head(data: bytes, at: int) -> tuple[list[str], int]:
    """The lines of a header and where what follows it begins; lines may end without a carriage return."""
    ends = [(e, len(m)) for m in (LINE + LINE, b"\n\n") if (e := data.find(m, at)) >= 0]
    end, mark = min(ends, default=(len(data), 0))
    return data[at:end].decode("utf-8", "replace").replace("\r\n", "\n").split("\n"), end + mark


def parse_records(data: bytes) -> list[tuple[Fields, bytes]]:
    """Headers and block of each record of uncompressed WARC bytes."""
    out, at = [], 0
    while at < len(data):
        lines, start = _head(data, at)
        headers = Fields(_fields(lines[1:]))
        size = headers.get("Content-Length", "")
        if not lines[0].startswith("WARC/") or not size.isdigit() or start + int(size) > len(data):
            raise ValueError(f"no whole record at byte {at}")
        at = start + int(size)
        out.append((headers, data[start:at]))
        while data[at:at + 1] in (b"\r", b"\n"):
            at += 1
    return out


def parse_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response block."""
    lines, start = _head(block, 0)
    return lines[0], _fields(lines[1:]), block[start:]


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body."""
    out, at = [], 0
    while True:
        end = body.find(b"\n", at)
        size = int(body[at:end if end >= 0 else len(body)].split(b";")[0].strip() or b"0", 16)
        if not size:
            return b"".join(out)
        if end < 0 or end + 1 + size > len(body):
            raise ValueError("a chunk is cut off")
        out.append(body[end + 1:end + 1 + size])
        at = end + 1 + size
        at += 2 if body[at:at + 2] == LINE else 1


def page_text(http: list[tuple[str, str]], body: bytes) -> tuple[bytes, str]:
    """The payload without transfer coding, and its text: unpacked, in the charset that the header or the page names.

    An unknown charset reads as UTF-8; what doesn't fit a charset becomes U+FFFD.
    """
    fields = Fields(http)
    payload = dechunked(body) if "chunked" in fields.get("Transfer-Encoding", "").lower() else body
    packed = fields.get("Content-Encoding", "").lower()
    raw = payload
    if payload and ("gzip" in packed or "deflate" in packed):
        try:
            raw = zlib.decompressobj(47).decompress(payload)  # gzip or zlib, by its head
        except zlib.error:
            raw = zlib.decompressobj(-15).decompress(payload)  # deflate without a head
    named = _CHARSET.search(fields.get("Content-Type", "")) or _CHARSET.search(raw[:1024].decode("latin-1"))
    name = named[1].lower() if named else "utf-8"
    try:
        return payload, raw.decode("cp1252" if name in ("iso-8859-1", "latin-1", "latin1", "us-ascii", "ascii") else name, "replace")
    except LookupError:
        return payload, raw.decode("utf-8", "replace")


def plain_text(markup: str) -> str:
    """Visible text: no scripts, styles, head or comments; block elements break lines; entities are decoded."""
    text = html.unescape(_TAG.sub("", _BLOCK.sub("\n", _DROPPED.sub(" ", markup))))
    return _LINES.sub("\n", _SPACES.sub(" ", text)).strip()


def _one_line(text: str) -> str:
    return " ".join(text.split())


def response_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, response``: one uncompressed response record per row; a null url or page counts as empty."""
    p = pages.select(pages[id_col].alias("page_id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))

    def build(batches):
        for batch in batches:
            out = []
            for page, url, markup in zip(batch["page_id"], batch["url"], batch["html"]):
                url, body = _one_line(url), markup.encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                out.append(record([
                    ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page), url, sha1(body))), ("WARC-Date", DATE), ("WARC-Target-URI", url),
                    ("WARC-Payload-Digest", sha1(body)), ("WARC-Block-Digest", sha1(http + body)), ("Content-Type", "application/http; msgtype=response")], http + body))
            yield pd.DataFrame({"page_id": batch["page_id"], "response": out})

    return p.mapInPandas(build, f"page_id {p.schema['page_id'].dataType.simpleString()}, response binary")


def derive_one(data: bytes) -> list[dict]:
    """The metadata and the conversion record of each response record in ``data``; an error row instead of what can't be read."""
    out = []
    try:
        records = parse_records(data)
    except ValueError as e:
        return [_error("", "", str(e))]
    for head, block in records:
        if head.get("WARC-Type", "").lower() != "response":
            continue
        uri, date = head.get("WARC-Target-URI", "").strip("<>"), head.get("WARC-Date", DATE)
        source = head.get("WARC-Record-ID") or record_id("response", uri, date, sha1(block))
        try:
            status, http, body = parse_http(block)
            payload, markup = page_text(http, body)
        except (ValueError, zlib.error) as e:
            out.append(_error(source, uri, str(e)))
            continue
        text = plain_text(markup)
        title = _TITLE.search(markup)
        links = [_one_line(html.unescape(a or b or c)) for a, b, c in _LINK.findall(markup)]
        digest = sha1(payload)
        told = head.get("WARC-Payload-Digest", digest)
        fields = [("source-status", status), *((f"source-header-{k.lower()}", v) for k, v in http), ("source-payload-digest", digest),
                  ("digest-verified", str(told in (digest, sha1(body))).lower()),
                  ("title", _one_line(html.unescape(title[1])) if title else ""), *(("outlink", x) for x in links)]
        for kind, mime, made in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode()), ("conversion", "text/plain; charset=utf-8", text.encode())):
            own = record_id(kind, source, sha1(made))
            bytes_ = record([("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", source),
                             ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Source-Payload-Digest", digest), ("WARC-Block-Digest", sha1(made)), ("Content-Type", mime)], made)
            out.append({"kind": kind, "record_id": own, "refers_to": source, "target_uri": uri, "source_digest": digest, "block_digest": sha1(made),
                        "block_bytes": len(made), "n_links": len(links), "record": bytes_, "error": None})
    return out


def _error(source: str, uri: str, why: str) -> dict:
    return {"kind": "error", "record_id": None, "refers_to": source, "target_uri": uri, "source_digest": None, "block_digest": None, "block_bytes": 0, "n_links": 0, "record": None, "error": why}


def derive(responses: DataFrame, id_col: str = "page_id", record_col: str = "response") -> DataFrame:
    """Two rows per response record: ``page_id, kind, record_id, refers_to, target_uri, source_digest, block_digest, block_bytes, n_links, record, error``.

    ``record`` is a whole WARC record; the records of a file, one after the other, are a WARC file. Every response
    gives both records, also with an empty page; other record types and null records give none. Field names are alike in
    any case, folded lines go on, a record without an id gets one from its content; chunked and packed payloads are
    unpacked and read in their own charset. Bytes that are no whole WARC record, or a payload that can't be unpacked,
    give one row of kind ``error`` and no failure. Pages are independent, so no row is shuffled.
    """
    r = responses.select(responses[id_col].alias("page_id"), responses[record_col].alias("response"))
    names = ["kind", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "block_bytes", "n_links", "record", "error"]

    def build(batches):
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.iloc[a:a + 256]
                rows = [{"page_id": p, **d} for p, x in zip(part["page_id"], part["response"]) if x is not None for d in derive_one(bytes(x))]
                if rows:
                    yield pd.DataFrame(rows, columns=["page_id", *names])

    kind = r.schema["page_id"].dataType.simpleString()
    return r.mapInPandas(build, f"page_id {kind}, kind string, record_id string, refers_to string, target_uri string, source_digest string, block_digest string, block_bytes long, n_links long, record binary, error string")

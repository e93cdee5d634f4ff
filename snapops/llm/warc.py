"""WARC derivatives: each response record gives a linked metadata and a plain-text conversion record.

Both name the response in WARC-Refers-To and keep its target and date; the metadata record
lists the response's own WARC and HTTP headers and its digests, and is named as concurrent to
the conversion. Digests are SHA-1 in base 32; record ids are version-5 style UUIDs over what
the record says, so a task that runs again makes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"<!--|<([a-zA-Z][a-zA-Z0-9]*|/[a-zA-Z][a-zA-Z0-9]*|[!?])[^<>]*>")
_HIDDEN = {"script", "style", "noscript", "template", "svg"}
_BLOCKS = set("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html body li main nav ol p pre section table td th title tr ul".split())


def plain_text(page: str) -> tuple[str, str]:
    """Title and visible text, one line for each block; linear in the page's length."""
    parts, title, at, in_title = [], [], 0, False
    lower = None
    for_search = _TAG.search
    while m := for_search(page, at):
        (title if in_title else parts).append(page[at : m.start()])
        at = m.end()
        if m[1] is None:
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
            continue
        name = m[1].lower()
        if name in _HIDDEN and not m[0].endswith("/>"):
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{name}", at) if len(lower) == len(page) else page.find(f"</{name}", at)
            at = len(page) if end < 0 else end
            continue
        in_title = name == "title" or in_title and name != "/title"
        if name.lstrip("/") in _BLOCKS:
            parts.append("\n")
    (title if in_title else parts).append(page[at:])
    clean = lambda s: " ".join(html.unescape(s).split())
    lines = (clean(x) for x in "".join(parts).split("\n"))
    return clean("".join(title)), "\n".join(x for x in lines if x)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: bytes) -> str:
    return f"<{uuid.UUID(bytes=hashlib.sha1(b'\0'.join(parts)).digest()[:16], version=5).urn}>"


def one_line(value: str) -> str:
    return " ".join(value.split())


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*headers, ("WARC-Block-Digest", sha1(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {one_line(v)}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers, in order, and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = [x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]]
    headers = [(k.strip(), v.strip()) for k, _, v in lines if k]
    length = next((int(v) for k, v in headers if k.lower() == "content-length" and v.isdigit()), max(0, len(rest) - 4))
    return headers, rest[:length]


def response(url: str | None, page: str | None, date: str, salt: str) -> bytes:
    payload = (page or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    target = one_line(url or "")
    own = record_id(b"response", salt.encode(), target.encode(), block)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", target)] if target else []
    return record([*headers, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1(payload))], block)


def derive(raw: bytes) -> list[tuple[str, list[tuple[str, str]], bytes]]:
    """``(type, headers, block)`` of the metadata and the conversion record of one response."""
    headers, block = parse(raw)
    by_name = {k.lower(): v for k, v in headers}
    http, _, payload = block.partition(b"\r\n\r\n")
    title, text = plain_text(payload.decode("utf-8", "replace"))
    source = by_name.get("warc-record-id", "")
    common = [("WARC-Refers-To", source)] + [(k, v) for k, v in headers if k.lower() in ("warc-target-uri", "warc-date")]
    body = text.encode()
    converted = record_id(b"conversion", source.encode(), body)
    fields = [("title", title)] + [(f"source-{k}", v) for k, v in headers]
    status, *rest = http.decode("utf-8", "replace").split("\r\n")
    fields += [("http-status", status)] + [(f"http-{k.strip()}", v.strip()) for k, _, v in (x.partition(":") for x in rest) if k]
    notes = "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields).encode()
    told = record_id(b"metadata", source.encode(), notes)
    return [
        ("metadata", [("WARC-Type", "metadata"), ("WARC-Record-ID", told), *common, ("WARC-Concurrent-To", converted), ("Content-Type", "application/warc-fields")], notes),
        ("conversion", [("WARC-Type", "conversion"), ("WARC-Record-ID", converted), *common, ("WARC-Source-Payload-Digest", by_name.get("warc-payload-digest", sha1(payload))), ("Content-Type", "text/plain; charset=utf-8")], body),
    ]


def _mapped(df: DataFrame, columns: list[str], schema: str, arrow: pa.Schema, rows_of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(c).to_pylist() for c in columns]
            for at in range(0, batch.num_rows, 500):
                rows = [x for row in zip(*(v[at : at + 500] for v in values), strict=True) for x in rows_of(*row)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * len(arrow), arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``page_id, url, html`` to ``page_id, record``: each page as a WARC response record.

    Null urls give records without a target, null pages an empty payload.
    """
    arrow = pa.schema([("page_id", pa.int64()), ("record", pa.binary())])
    return _mapped(pages, ["page_id", "url", "html"], "page_id long, record binary", arrow, lambda i, u, h: [(i, response(u, h, date, str(i)))])


def derivatives(records: DataFrame) -> DataFrame:
    """``page_id, record`` to two rows for each response: its metadata and its conversion record.

    Defined cases: a null record gives none; an empty payload gives an empty conversion;
    bytes that are not UTF-8 are replaced in the text; repeated rows give repeated records
    with the same ids; an empty table gives an empty result. Other columns are not read.
    """
    names = ["page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "source_digest", "record"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.string(), pa.binary()]

    def rows_of(page_id, raw):
        if raw is None:
            return
        source = dict(parse(raw)[0])
        for kind, headers, block in derive(raw):
            h = dict(headers)
            yield page_id, kind, h["WARC-Record-ID"], h["WARC-Refers-To"], h.get("WARC-Target-URI"), h["Content-Type"], len(block), sha1(block), source.get("WARC-Payload-Digest"), record(headers, block)

    schema = ", ".join(f"{n} {'long' if k == pa.int64() else 'binary' if k == pa.binary() else 'string'}" for n, k in zip(names, kinds, strict=True))
    return _mapped(records, ["page_id", "record"], schema, pa.schema(list(zip(names, kinds, strict=True))), rows_of)


def write_warc(derived: DataFrame, path: str) -> None:
    """The records as gzipped WARC files, one for each partition."""
    lines = derived.selectExpr("decode(substring(record, 1, length(record) - 4), 'UTF-8') AS value")
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)

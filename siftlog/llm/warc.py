"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

``responses`` makes a response record of each page. ``derive`` reads response records and builds for each a metadata
record (JSON: source headers, title and its length, links) and a conversion record (the text of the whole page, with its
title, menus and footers, but without scripts, styles, templates, noscript, iframe and svg elements). Both name the response in
``WARC-Refers-To``, and carry its target URI, date and payload digest; each has its own block digest.
Record identifiers are name-based, of page, url and payload digest, so that a task that runs again makes the same
records. Names of fields and headers are read in any case. Source headers are a list, so repeated ones stay. A chunked
body is joined, a gzip or deflate one unpacked. The payload's text is decoded by the charset of its Content-Type header,
else by the one that its first 1024 bytes name, else as UTF-8, as is one whose charset can't decode it. Without a payload
digest in the response the payload's own is carried; a given one may be that of the body with or without chunks.

Edge cases: a null page has an empty payload, a null url an empty target; records of other types (requests and so on)
have no derivatives; payloads that are no text (by their media type; none counts as HTML) and those packed in another way
have a metadata record only; plain text is kept as it is; what can't be read (no record, a field that is missing, broken
chunks) has no derivatives but its fault in ``error``, and the job goes on; a packed body that ends early gives what it
has; repeated pages give repeated records; long payloads stay whole; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.llm.common import bounded_batches
from siftlog.llm.html_text import all_text

VERSION = b"WARC/1.1"
#: Pages carry no time of their own.
DATE = "2000-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def make_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_list(lines: list[bytes], charset: str) -> list[tuple[str, str]]:
    """Names and values of header lines in order; a line that begins with white space continues the one before it."""
    out: list[tuple[str, str]] = []
    for text in b"\r\n".join(lines).decode(charset, "replace").split("\r\n"):
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif text:
            name, _, value = text.partition(":")
            out.append((name.strip(), value.strip()))
    return out


class Fields(dict):
    """Fields by name in any case; of repeated ones the first. Names as the standard writes them are looked up at once."""

    def __init__(self, pairs: list[tuple[str, str]]):
        super().__init__(reversed(pairs))
        self.pairs, self.lower = pairs, None

    def __missing__(self, name: str) -> str:
        if self.lower is None:
            self.lower = {k.lower(): v for k, v in reversed(self.pairs)}
        return self.lower[name.lower()]

    def get(self, name: str, other=None):
        try:
            return self[name]
        except KeyError:
            return other


def read_record(data: bytes) -> tuple[Fields, bytes]:
    """The record's fields and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = Fields(header_list(lines, "utf-8"))
    size = fields.get("Content-Length", "")
    if not size.isdecimal():
        raise ValueError(f"no length but {size!r}")
    return fields, rest[: int(size)]


def unchunked(body: bytes) -> bytes:
    """A chunked body's content; trailers are left out."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at : end if end >= 0 else len(body)].partition(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            raise ValueError(f"no size of a chunk but {size[:20]!r}")
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if end < 0 or end + 2 + n > len(body):
            raise ValueError("a chunk ends early")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n
        if body[at : at + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end with its size")
        at += 2


def unpacked(body: bytes, coding: str) -> bytes | None:
    """The content of a body packed by ``coding``, as far as it goes; None if that isn't known."""
    coding = {"x-gzip": "gzip", "": "identity"}.get(coding, coding)
    if coding == "identity" or not body:
        return body
    if coding == "gzip":
        out = b""
        while body:  # members may follow each other
            member = zlib.decompressobj(31)
            out, body = out + member.decompress(body) + member.flush(), member.unused_data
            if not member.eof:
                break
        return out
    if coding == "deflate":
        try:
            return zlib.decompressobj().decompress(body)
        except zlib.error:
            return zlib.decompressobj(-15).decompress(body)  # some servers leave the wrapper out
    return None


#: Media types whose payload is text with tags; all other texts are kept as they are.
MARKUP = frozenset(("", "text/html", "application/xhtml+xml", "text/xml", "application/xml"))


META_CHARSET = re.compile(rb"<meta\b[^<>]*?\bcharset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.IGNORECASE)


def decoded(payload: bytes, headers: list[tuple[str, str]]) -> str:
    """The payload's text by its charset; one that isn't known or doesn't fit counts as UTF-8."""
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    named = re.search(r"charset\s*=\s*[\"']?([^\s\"';]+)", kind, re.IGNORECASE)
    found = named.group(1) if named else (m.group(1).decode() if (m := META_CHARSET.search(payload[:1024])) else "utf-8")
    try:
        return payload.decode(found, "replace")
    except (LookupError, ValueError):  # no such codec, none of texts, or one that has no replacement
        return payload.decode("utf-8", "replace")


def _clean(url: str | None) -> str:
    return "".join((url or "").split())


def response(page_id: int | None, url: str | None, page: str | None) -> bytes:
    payload = (page or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", page_id, url, digest(payload))),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(http + payload)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return make_record(fields, http + payload)


def derivatives(record: bytes) -> tuple[bytes | None, bytes | None]:
    """The metadata and the conversion record of a response record; None for those that it doesn't have."""
    fields, block = read_record(record)
    if fields.get("WARC-Type", "").lower() != "response":
        return None, None
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.split(b"\r\n")
    headers = header_list(lines, "latin-1")
    named = Fields(headers)
    payload = unchunked(body) if named.get("Transfer-Encoding", "").strip().lower() == "chunked" else body
    content = payload
    for coding in reversed([c.strip().lower() for c in named.get("Content-Encoding", "").split(",")]):
        content = unpacked(content, coding) if content is not None else None
    media = named.get("Content-Type", "").partition(";")[0].strip().lower()
    markup = media in MARKUP
    readable = content is not None and (markup or media.startswith("text/"))
    text, links, title = all_text(decoded(content, headers)) if readable and markup else (decoded(content, headers) if readable else "", [], "")
    source, own, given = fields["WARC-Record-ID"], digest(body), fields.get("WARC-Payload-Digest")
    kept = [("WARC-Date", fields["WARC-Date"]), ("WARC-Target-URI", fields.get("WARC-Target-URI", "")), ("WARC-Refers-To", source), ("WARC-Payload-Digest", given or own)]
    right = given is None or given == own or (payload is not body and given == digest(payload))
    meta = json.dumps(
        {"envelope": {k: v for k, v in fields.items() if k.lower() != "content-length"}, "status": status.decode("latin-1"), "headers": headers, "payload_length": len(payload), "payload_digest_ok": right, "links": links, "title": title, "title_length": len(title)},
        ensure_ascii=False,
        sort_keys=True,
    ).encode("utf-8", "replace")
    metadata = make_record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", source)), *kept, ("WARC-Block-Digest", digest(meta)), ("Content-Type", "application/json")], meta)
    if not readable:
        return metadata, None
    plain = text.encode("utf-8", "replace")
    return metadata, make_record([("WARC-Type", "conversion"), ("WARC-Record-ID", record_id("conversion", source)), *kept, ("WARC-Block-Digest", digest(plain)), ("Content-Type", "text/plain; charset=utf-8")], plain)


def _derived(record: bytes | None) -> tuple[bytes | None, bytes | None, str | None]:
    """The derivatives of one record, or what is wrong with it."""
    if record is None:
        return None, None, "no record"
    try:
        return *derivatives(record), None
    except KeyError as e:
        return None, None, f"no field {e.args[0]}"
    except (ValueError, zlib.error) as e:
        return None, None, str(e)


def responses(pages: DataFrame) -> DataFrame:
    """page_id, url and record: a response record of each page."""
    bounded_batches(pages.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([response(*r) for r in rows], pa.binary())], names=["page_id", "url", "record"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(make, "page_id long, url string, record binary")


def derive(records: DataFrame) -> DataFrame:
    """``records`` (page_id, url, record) with the metadata and conversion records beside each response, and the fault of
    one that can't be read as ``error``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_derived(r) for r in batch.column(2).to_pylist()]
            new = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *new], names=["page_id", "url", "record", "metadata", "conversion", "error"])

    return records.select("page_id", "url", "record").mapInArrow(build, "page_id long, url string, record binary, metadata binary, conversion binary, error string")


def write_files(derived: DataFrame, folder: str) -> DataFrame:
    """Write each partition's records as one file, a response followed by its derivatives; returns path and records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, n = f"{folder}/part-{uuid.uuid4().hex}.warc", None, 0
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if out is None:
                    system, name = fs.FileSystem.from_uri(path)
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(name)
                for record in row:
                    if record is not None:
                        out.write(record)
                        n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return derived.select("record", "metadata", "conversion").mapInArrow(write, "path string, records long")


def digests(derived: DataFrame) -> DataFrame:
    """A row for each record: identifiers, links between the records and digests, read back from the records; null where
    there is no such record."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing: tuple[Fields, None] = (Fields([]), None)
        for batch in batches:
            rows = []
            for record, metadata, conversion, error in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4, 5)], strict=True):
                (m, meta), (c, text) = (read_record(x) if x is not None else nothing for x in (metadata, conversion))
                r = read_record(record)[0] if error is None and record is not None else nothing[0]
                links = None if meta is None else len(json.loads(meta)["links"])
                rows.append((r.get("WARC-Record-ID"), m.get("WARC-Record-ID"), c.get("WARC-Record-ID"), m.get("WARC-Refers-To"), c.get("WARC-Refers-To"), m.get("WARC-Payload-Digest"), m.get("WARC-Block-Digest"), c.get("WARC-Block-Digest"), links, None if text is None else len(text.decode())))
            columns = [pa.array([x[i] for x in rows], pa.string() if i < 8 else pa.int64()) for i in range(10)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, batch.column(5)], names=names)

    names = ["page_id", "url", "response_id", "metadata_id", "conversion_id", "metadata_refers_to", "conversion_refers_to", "payload_digest", "metadata_digest", "conversion_digest", "n_links", "n_chars", "error"]
    return derived.mapInArrow(read, ", ".join(f"{n} {'long' if n in ('page_id', 'n_links', 'n_chars') else 'string'}" for n in names))

"""Records as crawlers write them: packed, chunked, broken, of other types."""

from __future__ import annotations

import gzip
import json
import zlib

import pytest

from siftlog.llm import warc


def record(payload, http=(), fields=(), kind="response", status="HTTP/1.1 200 OK", names=str):
    given = [("WARC-Type", kind), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Date", warc.DATE), *fields]
    return warc.make_record([(names(k), v) for k, v in given], "\r\n".join([status, *http]).encode("latin-1") + b"\r\n\r\n" + payload)


def both(data):
    return [None if x is None else warc.read_record(x) for x in warc.derivatives(data)]


CHUNKED = b"6;x=y\r\n<p>hel\r\n1F\r\nlo world, how do you do today?\n\r\n4\r\n</p>\r\n0\r\nTrailer: 1\r\n\r\n"


def test_chunks_are_joined():
    meta, plain = both(record(CHUNKED, ["Transfer-Encoding: Chunked"]))
    assert plain[1].decode() == "hello world, how do you do today?"
    seen = json.loads(meta[1])
    assert seen["payload_digest_ok"] and seen["payload_length"] == 6 + 31 + 4
    joined = warc.unchunked(CHUNKED)
    for given, right in ((warc.digest(joined), True), (warc.digest(CHUNKED), True), (warc.digest(b""), False)):
        assert json.loads(both(record(CHUNKED, ["Transfer-Encoding: chunked"], [("WARC-Payload-Digest", given)]))[0][1])["payload_digest_ok"] is right


@pytest.mark.parametrize("coding", ["gzip", "x-gzip", "deflate", "raw", "identity", "gzip, deflate"])
def test_packed_bodies_are_read(coding):
    text = "<title>T</title><p>" + "packed words " * 500 + "é</p>"
    raw = zlib.compressobj(wbits=-15)
    packed = {"gzip": gzip.compress, "x-gzip": gzip.compress, "deflate": zlib.compress, "raw": lambda b: raw.compress(b) + raw.flush(), "identity": lambda b: b, "gzip, deflate": lambda b: zlib.compress(gzip.compress(b))}[coding](text.encode())
    meta, plain = both(record(packed, [f"Content-Encoding: {'deflate' if coding == 'raw' else coding}"]))
    assert plain[1].decode() == "T\n" + ("packed words " * 500 + "é").strip()
    assert json.loads(meta[1])["title"] == "T" and plain[0]["WARC-Payload-Digest"] == warc.digest(packed)


def test_members_and_early_ends():
    two = gzip.compress(b"<p>one</p>") + gzip.compress(b"<p>two</p>")
    assert both(record(two, ["Content-Encoding: gzip"]))[1][1] == b"one\ntwo"
    short = gzip.compress(b"<p>" + bytes(range(97, 123)) * 50 + b"</p>")[:-12]
    assert both(record(short, ["Content-Encoding: gzip"]))[1][1].startswith(b"abcdef")


def test_only_texts_are_converted():
    for media, there in (("image/png", False), ("application/pdf", False), ("text/html", True), ("TEXT/HTML; charset=utf-8", True), ("application/xhtml+xml", True), ("text/plain", True), ("text/css", True)):
        meta, plain = both(record(b"a <b>c</b> \xff", [f"Content-Type: {media}"]))
        assert meta is not None and (plain is not None) is there, media
    assert both(record(b"a <b>c</b>\n d", ["Content-Type: text/plain"]))[1][1] == b"a <b>c</b>\n d"
    meta, plain = both(record(b"\x0b\x02", ["Content-Encoding: br"]))
    assert meta is not None and plain is None


@pytest.mark.parametrize("kind", ["request", "warcinfo", "metadata", "revisit"])
def test_other_types_have_no_derivatives(kind):
    assert warc.derivatives(record(b"<p>x</p>", kind=kind)) == (None, None)


@pytest.mark.parametrize("names", [str.lower, str.upper])
def test_names_in_any_case(names):
    _, plain = both(record(b"<p>caf\xe9</p>", ["content-TYPE: text/html; Charset=latin-1"], [("WARC-Target-URI", "u")], names=names))
    assert plain[1].decode() == "café" and plain[0]["warc-target-uri"] == "u" and plain[0]["WARC-Refers-To"] == "<urn:uuid:1>"


@pytest.mark.parametrize("charset", ["idna", "punycode", "undefined", "rot13", "hex", "base64", "no-such", "utf-16"])
def test_codecs_that_fail(charset):
    _, plain = both(record("<p>straße</p>".encode(), [f"Content-Type: text/html; charset={charset}"]))
    assert plain is not None and (charset in ("utf-16", "punycode") or plain[1].decode() == "straße")


def test_bad_records_become_rows_with_an_error(spark):
    good = record(b"<p>fine</p>")
    bad = {
        "text": b"hello",
        "empty": b"",
        "no length": b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx",
        "odd length": b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: -5\r\n\r\nx",
        "no id": warc.make_record([("WARC-Type", "response"), ("WARC-Date", warc.DATE)], b"HTTP/1.1 200 OK\r\n\r\nx"),
        "no date": warc.make_record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>")], b"HTTP/1.1 200 OK\r\n\r\nx"),
        "chunks": record(b"zz\r\nabc", ["Transfer-Encoding: chunked"]),
        "short chunk": record(b"ff\r\nabc", ["Transfer-Encoding: chunked"]),
        "not gzip": record(b"plain", ["Content-Encoding: gzip"]),
        "null": None,
    }
    rows = [(i, "u", r) for i, r in enumerate([*bad.values(), good, record(b"", kind="request"), good])]
    derived = warc.derive(spark.createDataFrame(rows, "page_id long, url string, record binary").repartition(3))
    got = {r["page_id"]: r for r in warc.digests(derived).collect()}
    n = len(bad)
    assert all(got[i]["error"] and got[i]["metadata_id"] is None and got[i]["conversion_id"] is None for i in range(n))
    assert got[n]["error"] is None and got[n]["n_chars"] == 4
    assert got[n + 1]["error"] is None and got[n + 1]["metadata_id"] is None
    assert [x for x in got[n + 2] if x not in (n + 2,)] == [x for x in got[n] if x not in (n,)]


def test_equal_pages_twice(spark, tmp_path):
    page = "<title>t</title><body><p>same text</p></body>"
    pages = spark.createDataFrame([(1, "http://a", page), (1, "http://a", page), (2, "http://a", page), (None, None, None)], "page_id long, url string, html string")
    derived = warc.derive(warc.responses(pages))
    rows = sorted(map(tuple, warc.digests(derived).collect()), key=str)
    one, two = [r for r in rows if r[0] == 1]
    other = next(r for r in rows if r[0] == 2)
    assert one == two and one[2] != other[2] and one[7] == other[7] and one[9] == other[9]
    files = warc.write_files(derived, f"file://{tmp_path}").collect()
    assert sum(f["records"] for f in files) == 12

"""WARC files: streamed records, faults that lose no later record, the source's own
digests and headers, payload encodings."""

import gzip
import hashlib
import io
import zlib

import pytest

from tidewatch.llm import warc
from tidewatch.llm import warc_files as wf


def record(rid, block, kind="response", more="", length=None):
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\n{more}"
            f"Content-Length: {len(block) if length is None else length}\r\n\r\n").encode() + block + b"\r\n\r\n"


def http(body, *headers):
    return "\r\n".join(["HTTP/1.1 200 OK", *headers, "", ""]).encode() + body


def got(data):
    out = []
    for at, head, block, fault in wf.stream_records(io.BytesIO(data)):
        out.append(fault if fault else wf.header_fields(head)["warc-record-id"])
    return out


def test_faults_lose_no_later_record():
    a, b, c = (record(x, b"x" * 10) for x in "abc")
    assert got(a + b"junk\r\nmore" + b + c) == ["<a>", "bytes that start no record", "<b>", "<c>"]
    none = b"WARC/1.1\r\nWARC-Type: response\r\n\r\nblock\r\n\r\n"
    assert got(a + none + b) == ["<a>", "a header without a length", "<b>"]
    assert got(a + record("x", b"y", length="many") + b) == ["<a>", "a header without a length", "<b>"]
    assert got(a + b[:-8]) == ["<a>", "a record cut off after 6 of 10 bytes"]
    assert got(b"WARC/1.1\r\nContent-Length: 3") == ["a header without an end"]
    assert got(b"") == [] == got(b"\r\n\r\n")
    # a record's own text is passed by its length, whatever it holds
    assert got(record("a", b"\r\n\r\n" + b) + c) == ["<a>", "<c>"]


def test_places_are_those_of_the_file():
    a, b = record("a", b"1"), record("b", b"2")
    rows = list(wf.stream_records(a + b"junk\r\n" + b))
    assert [r[0] for r in rows] == [0, len(a), len(a) + 6]


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 18])
def test_any_chunk_size_gives_the_same_records(monkeypatch, step):
    monkeypatch.setattr(wf, "STEP", step)
    parts = [record(str(k), bytes([k]) * (k * 37)) for k in range(12)]
    want = [f"<{k}>" for k in range(12)]
    assert got(b"".join(parts)) == want
    assert got(b"".join(gzip.compress(p) for p in parts)) == want
    assert got(gzip.compress(b"".join(parts)) + b"\0" * 20) == want


def test_a_broken_gzip_member_costs_its_own_record():
    members = [gzip.compress(record(str(k), hashlib.sha256(bytes([k])).digest() * 20)) for k in range(4)]
    bad = bytearray(members[1])
    bad[len(bad) // 2:len(bad) // 2 + 8] = b"\xff" * 8
    rows = got(members[0] + bytes(bad) + members[2] + members[3])
    assert [r for r in rows if r.startswith("<")][0] == "<0>" and rows[-2:] == ["<2>", "<3>"]
    assert any(r.startswith("broken gzip") for r in rows)
    rows = got(members[0] + members[1][:-20])
    assert rows[0] == "<0>" and rows[-1].startswith("broken gzip")


def test_records_of_other_types_are_not_held():
    class Zeros(io.RawIOBase):
        """A head, then many zeros, then a record."""
        def __init__(self, head, zeros, tail):
            self.head, self.zeros, self.tail, self.most = head, zeros, tail, 0

        def read(self, n=-1):
            self.most = max(self.most, n)
            if self.head:
                out, self.head = self.head[:n], self.head[n:]
            elif self.zeros:
                out, self.zeros = bytes(min(n, self.zeros)), max(0, self.zeros - n)
            else:
                out, self.tail = self.tail[:n], self.tail[n:]
            return out

        def seek(self, at, whence=0):
            self.head = self.first
            return 0
    size = 300 << 20
    head = record("big", b"", "request", length=size)[:-4]
    raw = Zeros(head, size, b"\r\n\r\n" + record("a", b"z"))
    raw.first = head
    window = wf._Window(raw)
    window.drop(len(head) + size)
    assert len(window.buf) <= 2 * wf.STEP
    raw.head, raw.zeros, raw.tail = head, size, b"\r\n\r\n" + record("a", b"z")
    rows = list(wf.stream_records(raw, "response"))
    assert [wf.header_fields(r[1])["warc-record-id"] for r in rows] == ["<a>"]


@pytest.mark.parametrize("body, kind, text", [
    ("é".encode(), "text/html; charset=utf-8", "é"), ("é".encode("latin-1"), "text/html; charset=ISO-8859-1", "é"),
    (b"\x80", "text/html; charset=latin1", "€"), ("語".encode("shift_jis"), 'text/html; charset="Shift_JIS"', "語"),
    ("é".encode("utf-16"), None, "é"), ("﻿é".encode("utf-8"), "text/html; charset=utf-8", "é"),
    (b'<meta charset="windows-1251">' + "ж".encode("cp1251"), "text/html", '<meta charset="windows-1251">ж'),
    (b"\xff", None, "�"), (b"a", "text/html; charset=nosuch", "a"), (b"a", "text/html; charset=hex", "a"),
    (b"a", "x; charset=idna", "a"), (b"", None, ""), (b'<meta charset="utf-16">a', None, '<meta charset="utf-16">a')])
def test_charsets(body, kind, text):
    assert wf.decoded(body, kind) == text


def test_content_and_transfer_encodings():
    raw = zlib.compressobj(wbits=-15)
    bare = raw.compress(b"hello") + raw.flush()
    chunks = b"3\r\nhel\r\n2;x=y\r\nlo\r\n0\r\n\r\n"
    for body, fields in [(gzip.compress(b"hello"), {"content-encoding": "gzip"}),
                         (gzip.compress(b"hel") + gzip.compress(b"lo"), {"content-encoding": "x-gzip"}),
                         (zlib.compress(b"hello"), {"content-encoding": "deflate"}),
                         (bare, {"content-encoding": "Deflate"}),
                         (chunks, {"transfer-encoding": "chunked"}),
                         (gzip.compress(zlib.compress(b"hello")), {"content-encoding": "deflate, gzip"}),
                         (b"hello", {"content-encoding": "gzip"}), (b"hello", {"content-encoding": "br"}),
                         (b"hello", {"transfer-encoding": "chunked", "content-encoding": "identity"})]:
        assert wf.uncoded(body, fields) == (b"hello", None), fields
    z = gzip.compress(b"hello")
    framed = b"%x\r\n" % len(z) + z + b"\r\n0\r\n\r\n"
    assert wf.uncoded(framed, {"transfer-encoding": "chunked", "content-encoding": "gzip"}) == (b"hello", None)
    assert wf.uncoded(b"\xff\xfe\x00", {"content-encoding": "br"}) == (None, "content encoding br is not read")
    long = gzip.compress(b"hello" * 1000)
    part, fault = wf.uncoded(long[:-9], {"content-encoding": "gzip"})
    assert b"hello" * 1000 == part[:5000] or fault == "an encoded payload is cut off"


def test_scan_keeps_sources_digests_and_headers(spark, tmp_path):
    page = "<html><title>é</title>ü</html>".encode("latin-1")
    one = record("urn:uuid:1", http(gzip.compress(page, mtime=0), "Content-Type: text/html; charset=iso-8859-1",
                                    "Content-Encoding: gzip", "X-A: b"),
                 more="WARC-Target-URI: http://a/\r\nWARC-Date: 2024-05-05T00:00:00Z\r\n"
                      "WARC-Payload-Digest: sha1:ABC\r\n")
    two = record("urn:uuid:2", http(b"\xff\xfd", "Content-Encoding: br"))
    data = one + b"junk\r\n" + record("q", b"GET /", "request") + two
    for folder, packed in (("a.warc", data), ("b.warc.gz", gzip.compress(data)), ("c.warc", b"")):
        (tmp_path / folder).write_bytes(packed)
    scanned = wf.scan_warc(spark, str(tmp_path))
    bad = [(r["path"][-3:], r["at"], r["fault"]) for r in wf.faults(scanned).collect()]
    junk, br = "bytes that start no record", "content encoding br is not read"
    assert sorted(bad) == sorted((p, at, f) for p in ("arc", ".gz") for at, f in
                                 [(len(one), junk), (len(data) - len(two), br)])
    rows = wf.responses(scanned).filter("path LIKE '%a.warc'").collect()
    assert [r["record_id"] for r in rows] == ["<urn:uuid:1>", "<urn:uuid:2>"]
    first, second = rows
    assert first["payload"] == "<html><title>é</title>ü</html>" and first["payload_digest"] == "sha1:ABC"
    assert "WARC-Payload-Digest: sha1:ABC" in first["warc_headers"] and "X-A: b" in first["http_headers"]
    assert second["payload"] is None
    assert second["payload_digest"] == "sha256:" + hashlib.sha256(b"\xff\xfd").hexdigest()
    made = {(r["refers_to"], r["warc_type"]): r for r in
            warc.derivatives(wf.responses(scanned).filter("path LIKE '%a.warc'")).collect()}
    assert len(made) == 4
    for kind in ("metadata", "conversion"):
        r = made["<urn:uuid:1>", kind]
        assert r["source_digest"] == "sha1:ABC" and r["refers_to_uri"] == "http://a/"
        assert r["source_content_type"] == "text/html; charset=iso-8859-1"
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
    assert made["<urn:uuid:1>", "conversion"]["block"] == "é\nü" or "ü" in made["<urn:uuid:1>", "conversion"]["block"]
    lines = made["<urn:uuid:1>", "metadata"]["block"].split("\r\n")
    assert "title: é" in lines and "http-header: X-A: b" in lines and "http-header: HTTP/1.1 200 OK" in lines
    assert "warc-header: WARC-Payload-Digest: sha1:ABC" in lines and lines[-1] == ""
    # what is written reads back, with the source's digest in its headers
    records = warc.warc_bytes(warc.derivatives(wf.responses(scanned).filter("path LIKE '%a.warc'"))).collect()
    back = list(wf.parse_records(b"".join(bytes(r["record"]) for r in records)))
    assert [b.decode() for _, b in back] == [r["block"] for r in records]
    assert {h["warc-source-payload-digest"] for h, _ in back} == {"sha1:ABC", second["payload_digest"]}


def test_a_path_of_another_scheme_is_read_by_spark(spark, tmp_path, monkeypatch):
    (tmp_path / "a.warc").write_bytes(record("a", http(b"x")))
    want = wf.scan_warc(spark, str(tmp_path)).collect()
    monkeypatch.setattr(wf, "SCHEMES", ("hdfs",))
    assert wf.scan_warc(spark, str(tmp_path)).collect() == want and len(want) == 1


def test_null_headers_and_digests_fall_back(spark):
    rows = spark.createDataFrame([("<a>", None, None, None, "x", None, None, None),
                                  ("<b>", None, None, None, None, "d", "", "A: b\r\n c\r\nD: e")], wf.SOURCE)
    made = {(r["refers_to"], r["warc_type"]): r for r in warc.derivatives(rows).collect()}
    assert made["<a>", "metadata"]["source_digest"] == "sha256:" + hashlib.sha256(b"x").hexdigest()
    assert "header" not in made["<a>", "metadata"]["block"]
    assert made["<b>", "conversion"]["source_digest"] == "d" and made["<b>", "conversion"]["block"] == ""
    assert made["<b>", "metadata"]["block"].endswith("http-header: A: b c\r\nhttp-header: D: e\r\n")

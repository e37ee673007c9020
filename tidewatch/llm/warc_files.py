"""Reading WARC files: records as a stream, faults as rows (operator 4).

A file is read forwards, a chunk at a time, plain or gzipped (one member a record or
one for all); a task holds one response record, never a file. Where bytes start no
record, a header has no end or no length, a record is cut off or a gzip member is
broken, a fault row says where, and reading goes on at the next record (the next
version line, as ``WARC/1.1``; behind a broken member, the next one). Records of other
types are passed over unread.

A payload is the HTTP body without chunk frames and content encoding, decoded by the
charset of the HTTP header, else of a byte order mark, else of a ``<meta>`` in its
first 1,024 bytes, else UTF-8. Its digest is the record's own ``WARC-Payload-Digest``;
without one, SHA-256 of the body as it lies in the file.
"""

from __future__ import annotations

import codecs
import hashlib
import io
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.capture_ranges import SCHEMES, _opened

STEP = 1 << 18
LONGEST_HEAD = 1 << 20
# A longer record cannot be a cell of Spark's; it gives a fault row.
LONGEST_BLOCK = 1 << 29
FULL = 8 << 20            # bytes of payloads in a batch of rows

RESPONSE = ("record_id string, target_uri string, warc_date string, content_type string, "
            "payload string")
SOURCE = f"{RESPONSE}, payload_digest string, warc_headers string, http_headers string"
SCANNED = f"path string, at long, {SOURCE}, fault string"
_NAMES = [c.split()[0] for c in SCANNED.split(", ")]


_VERSION = re.compile(rb"WARC/[0-9]\.[0-9]{1,2}\r\n")
_VERSION_BYTES = 11


class _Members:
    """The bytes of a gzip file. A broken member raises ``zlib.error`` once; the next
    ``read`` goes on with the member behind it."""

    def __init__(self, raw):
        self.raw, self.left, self.member = raw, b"", None

    def read(self, n: int) -> bytes:
        while True:
            self.left = self.left or self.raw.read(STEP)
            if not self.left:
                if self.member is None:
                    return b""
                self.member = None
                raise zlib.error("the file ends inside a gzip member")
            if self.member is None:
                self.left = self.left.lstrip(b"\0")      # padding between members
                if not self.left:
                    continue
                self.member = zlib.decompressobj(31)
            try:
                out = self.member.decompress(self.left, n)
            except zlib.error:
                self._next_member()
                raise
            if self.member.eof:
                self.left, self.member = self.member.unused_data, None
            else:
                self.left = self.member.unconsumed_tail
            if out:
                return out

    def _next_member(self) -> None:
        self.member, seen = None, self.left[1:]
        while (at := seen.find(b"\x1f\x8b\x08")) < 0:
            more = self.raw.read(STEP)
            if not more:
                self.left = b""
                return
            seen = seen[-2:] + more
        self.left = seen[at:]


class _Window:
    """A forward reader that can look ahead."""

    def __init__(self, raw):
        self.raw, self.buf, self.at = raw, bytearray(), 0

    def fill(self, n: int) -> bool:
        """Whether ``n`` bytes lie ahead."""
        while len(self.buf) < n:
            more = self.raw.read(STEP)
            if not more:
                return False
            self.buf += more
        return True

    def drop(self, n: int) -> None:
        """Pass ``n`` bytes, as far as there are."""
        while n > 0 and self.fill(1):
            k = min(n, len(self.buf))
            del self.buf[:k]
            self.at += k
            n -= k

    def take(self, n: int) -> bytes:
        self.fill(n)
        out = bytes(self.buf[:n])
        self.drop(len(out))
        return out

    def find(self, what: bytes, limit: int) -> int:
        """Where ``what`` begins within ``limit`` bytes ahead, or -1."""
        seen = 0
        while True:
            at = self.buf.find(what, max(0, seen - len(what) + 1), limit)
            if at >= 0 or len(self.buf) >= limit:
                return at
            seen = len(self.buf)
            if not self.fill(seen + 1):
                return -1

    def next_record(self) -> None:
        """Go on to the next version line, or to the end."""
        while self.fill(_VERSION_BYTES):
            found = _VERSION.search(self.buf)
            self.drop(found.start() if found else len(self.buf) - _VERSION_BYTES + 1)
            if found:
                return
        self.drop(len(self.buf))


def header_fields(head: str) -> dict[str, str]:
    """Header lines by lower-case name; the first of a name counts, folded lines are one."""
    out: dict[str, str] = {}
    for line in re.sub(r"\r?\n[ \t]+", " ", head).splitlines():
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def stream_records(raw, kind: str | None = None):
    """(place, header text, block, fault) of a WARC file open for reading: a row per whole
    record (of type ``kind``, if given) and per fault, in file order."""
    if isinstance(raw, bytes):
        raw = io.BytesIO(raw)
    first = raw.read(2)
    raw.seek(0)
    w = _Window(_Members(raw) if first == b"\x1f\x8b" else raw)
    while True:
        try:
            while w.fill(1) and w.buf[0] in b"\r\n":
                w.drop(1)
            if not w.fill(1):
                return
            at = w.at
            if not w.fill(5) or not w.buf.startswith(b"WARC/"):
                w.next_record()
                yield at, None, None, "bytes that start no record"
                continue
            end = w.find(b"\r\n\r\n", LONGEST_HEAD)
            if end < 0:
                w.drop(5)
                w.next_record()
                yield at, None, None, "a header without an end"
                continue
            head = w.take(end + 4)[:-4].decode("utf-8", "replace").partition("\r\n")[2]
            fields = header_fields(head)
            length = fields.get("content-length", "")
            if not re.fullmatch(r"[0-9]{1,18}", length):
                w.next_record()
                yield at, head, None, "a header without a length"
                continue
            n = int(length)
            wanted = kind is None or fields.get("warc-type") == kind
            if wanted and n <= LONGEST_BLOCK:
                block = w.take(n)
                got = len(block)
            else:
                start = w.at
                w.drop(n)
                block, got = None, w.at - start
            if got < n:
                yield at, head, None, f"a record cut off after {got} of {n} bytes"
            elif wanted:
                yield at, head, block, None if block is not None else f"a record of {n} bytes is too long"
        except zlib.error as e:
            place = w.at
            w.buf.clear()
            yield place, None, None, f"broken gzip: {e}"


def parse_records(data: bytes):
    """(headers, block) of each whole record of a WARC file's bytes, plain or gzipped;
    what is broken is passed over (``stream_records`` tells where)."""
    for _, head, block, fault in stream_records(data):
        if fault is None:
            yield header_fields(head), block


def _unchunked(body: bytes) -> bytes | None:
    """The body without chunk frames; None where it is not framed from start to end
    (crawlers often remove the frames and keep the header)."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at, at + 1024)
        size = re.fullmatch(rb"([0-9A-Fa-f]{1,8})[ \t]*(?:;.*)?", body[at:end]) if end >= 0 else None
        if size is None:
            return None
        n, at = int(size[1], 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n:at + n + 2] != b"\r\n":
            return None
        out.append(body[at:at + n])
        at += n + 2


def _inflated(body: bytes, bits: int) -> tuple[bytes | None, str | None]:
    """(the decompressed members, a fault or None); None where ``body`` is not so coded."""
    out, size = [], 0
    while True:
        z = zlib.decompressobj(bits)
        try:
            out.append(z.decompress(body, LONGEST_BLOCK - size))
        except zlib.error:
            return (b"".join(out), "an encoded payload is broken") if out else (None, None)
        size += len(out[-1])
        if not z.eof:
            return b"".join(out), ("an encoded payload is too long" if z.unconsumed_tail
                                   else "an encoded payload is cut off")
        if bits != 31 or not z.unused_data or size >= LONGEST_BLOCK:
            return b"".join(out), None
        body = z.unused_data


def uncoded(body: bytes, fields: dict[str, str]) -> tuple[bytes | None, str | None]:
    """(the body without chunk frames and content encoding, a fault or None). A body that
    does not bear the encoding its header names is taken as already decoded. An encoding
    other than gzip and deflate gives None and a fault, but where the body is UTF-8."""
    if "chunked" in fields.get("transfer-encoding", "").lower():
        plain = _unchunked(body)
        body = body if plain is None else plain
    fault = None
    for name in reversed([x.strip().lower() for x in fields.get("content-encoding", "").split(",")]):
        if name in ("", "identity"):
            continue
        if name in ("gzip", "x-gzip", "deflate"):
            kinds = (47, -15) if name == "deflate" else (31,)
            made = next((m for m in (_inflated(body, k) for k in kinds) if m[0] is not None), (body, None))
            body, fault = made[0], fault or made[1]
            continue
        try:
            body.decode("utf-8")
        except UnicodeDecodeError:
            return None, f"content encoding {name} is not read"
    return body, fault


_META = re.compile(rb"(?i)<meta[^>]{0,512}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)")
_CHARSET = re.compile(r"(?i)charset\s*=\s*[\"']?\s*([A-Za-z0-9_:.-]+)")
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def decoded(body: bytes, content_type: str | None) -> str:
    """The text of a payload. Browsers read Latin-1 and ASCII as Windows-1252, and so does
    this; an unknown charset is UTF-8, bytes that are none give U+FFFD."""
    told, mark = _CHARSET.search(content_type or ""), next((m for m in _MARKS if body.startswith(m[0])), None)
    meta = _META.search(body, 0, 1024)
    name = told[1] if told else mark[1] if mark else meta[1].decode() if meta else "utf-8"
    if mark and name.lower().replace("-", "")[:5] == mark[1].replace("-", "")[:5]:
        body, name = body[len(mark[0]):], mark[1]
    if meta and not told and not mark and name.lower().startswith("utf-16"):
        name = "utf-8"                                   # a readable <meta> is no UTF-16
    if name.lower() in ("iso-8859-1", "iso8859-1", "latin-1", "latin1", "us-ascii", "ascii"):
        name = "windows-1252"
    try:
        return body.decode(name, "replace")
    except (LookupError, UnicodeError, ValueError):
        return body.decode("utf-8", "replace")


def _rows(path: str, raw):
    for at, head, block, fault in stream_records(raw, "response"):
        if fault is not None:
            yield (path, at, *[None] * 8, fault)
            continue
        h, kind, body, http = header_fields(head), None, block, None
        fields: dict[str, str] = {}
        if block.startswith(b"HTTP/"):
            split = re.search(rb"\r?\n\r?\n", block)
            http = block[:split.start() if split else len(block)].decode("latin-1")
            body = block[split.end():] if split else b""
            fields = header_fields(http)
            kind = fields.get("content-type")
        else:
            kind = h.get("content-type")
        own = h.get("warc-payload-digest") or "sha256:" + hashlib.sha256(body).hexdigest()
        plain, fault = uncoded(body, fields)
        text = None if plain is None else decoded(plain, kind)
        yield (path, at, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), kind,
               text, own, head, http, None)
        if fault is not None:
            yield (path, at, *[None] * 8, fault)


def _frames(path: str, raw):
    rows, held = [], 0
    for row in _rows(path, raw):
        rows.append(row)
        held += len(row[6] or "")
        if len(rows) == 500 or held > FULL:
            yield pd.DataFrame(rows, columns=_NAMES, dtype=object)
            rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=_NAMES, dtype=object)


def _scan_opened(frames):
    for pdf in frames:
        for path in pdf["path"]:
            try:
                with _opened(path) as raw:
                    yield from _frames(path, raw)
            except FileNotFoundError:
                yield pd.DataFrame([(path, 0, *[None] * 8, "the file is gone")], columns=_NAMES, dtype=object)


def _scan_content(frames):
    for pdf in frames:
        for path, content in zip(pdf["path"], pdf["content"]):
            yield from _frames(path, io.BytesIO(bytes(content)))


def scan_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records and faults of the WARC files at ``path``, in the columns of
    ``SCANNED``: a row has either a ``fault`` or the record's columns. ``at`` is the
    record's place in the (uncompressed) file. Tasks open files by Arrow's file systems and
    stream them; those of another scheme are read by Spark, a file a row. An empty file
    gives no row. A file that goes away during the job gives a fault; any other failure to
    read fails the task, which Spark tries again."""
    files = spark.read.format("binaryFile").load(path)
    scheme = F.coalesce(F.nullif(F.regexp_extract("path", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit("")),
                        F.lit("file"))
    near = files.filter(scheme.isin(*SCHEMES)).select("path").mapInPandas(_scan_opened, SCANNED)
    other = files.filter(~scheme.isin(*SCHEMES)).select("path", "content") \
        .mapInPandas(_scan_content, SCANNED)
    return near.unionByName(other)


def responses(scanned: DataFrame) -> DataFrame:
    """The response records of ``scan_warc``, with the source's own digest and headers."""
    return scanned.filter(F.col("fault").isNull()).drop("fault")


def faults(scanned: DataFrame) -> DataFrame:
    """(path, at, fault) of what ``scan_warc`` could not read."""
    return scanned.filter(F.col("fault").isNotNull()).select("path", "at", "fault")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, their five columns alone. An HTTP header block
    before the payload is split off; its content type becomes the record's."""
    names: list[Column] = [F.col(c.split()[0]) for c in RESPONSE.split(", ")]
    return responses(scan_warc(spark, path)).select(*names)

"""Packet captures -> ``packets`` rows.

The one Python boundary of the engine. Spark lists the files; their bytes come
either whole (``binaryFile``, a task per file: small captures, streams) or in ranges
of records, many tasks per file (``capture_ranges.py``); ``mapInPandas`` decodes
them in Arrow batches. Record boundaries are found with one ``struct`` step per record, then
every header field is read for all records of a slice at once with numpy, and
each slice leaves the task before the next is decoded.

Formats: classic pcap (both byte orders, microsecond or nanosecond stamps)
and pcapng (section header, interface description with ``if_tsresol``,
enhanced and simple packet blocks). Link types: Ethernet (VLAN tags
skipped), raw IPv4/IP, Linux cooked capture, BSD loopback. Only IPv4 packets
become rows (P12); ports come from TCP, else UDP, else 0 (P13).

A bad record is skipped and the rest is kept where its framing allows; a file with
a fault yields one row with ``error`` set beside its packets, a file above the size
limit that row alone (S8, S15). A file without any packet row also yields a row
with nothing but its name, so that it stays known. ``split_errors`` separates
errors from packets.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PACKETS

# Fixed values of the formats: accepted extensions and the 500 MB cap.
EXTENSIONS = ("pcap", "pcapng", "cap")
MAX_BYTES = 500 * 1024 * 1024

PARSED = T.StructType(PACKETS.fields + [T.StructField("error", T.StringType())])

LINK_ETHERNET, LINK_RAW, LINK_RAW_ALT, LINK_SLL, LINK_NULL = 1, 101, 12, 113, 0


def _ci_glob(ext: str) -> str:
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in ext)


def extension_glob() -> str:
    """Case-insensitive glob for the accepted extensions."""
    return "{" + ",".join(_ci_glob(e) for e in EXTENSIONS) + "}"


def capture_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Accepted capture files with their bytes (S7); bytes are read only where
    ``content`` is used."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", extension_glob())
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path)


def capture_listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, length, accepted, too_large) for every file, without bytes."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(path).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", "length",
                        ext.isin(*EXTENSIONS).alias("accepted"),
                        (F.col("length") > MAX_BYTES).alias("too_large"))


# --- record framing --------------------------------------------------------

SLICE = 100_000          # records that are decoded together
_MAX_US = (1 << 63) - 1


class _Records:
    """A slice of record places, and the faults of the file so far."""

    def __init__(self):
        self.faults: list[str] = []
        self.first = 0           # number of the slice's first record
        self._clear()

    def _clear(self):
        self.offsets: list[int] = []
        self.lengths: list[int] = []
        self.ts_us: list[int] = []
        self.links: list[int] = []

    def add(self, pos: int, offset: int, length: int, ts_us: int, link: int) -> None:
        if 0 <= ts_us <= _MAX_US and length >= 0:
            self.offsets.append(offset)
            self.lengths.append(length)
            self.ts_us.append(ts_us)
            self.links.append(link)
        else:
            self.faults.append(f"bad time stamp or length at byte {pos}")

    def next_slice(self):
        self.first += len(self.offsets)
        self._clear()

    @property
    def error(self) -> str | None:
        if not self.faults:
            return None
        more = len(self.faults) - 1
        return self.faults[0] + (f" (and {more} more)" if more else "")


def _frame_pcap(buf: bytes, out: _Records, state: dict, more: bool = False):
    """Records of a pcap buffer. ``state`` holds what the file header says; it is read
    from the buffer where it is empty. ``state["at"]`` is the file's byte that the buffer
    begins with. With ``more`` to come, a record that is cut off is no fault. Returns the
    place up to which the buffer was read."""
    at, n, pos = state.setdefault("at", 0), len(buf), 0
    if "end" not in state:
        magic = buf[:4]
        if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1"):
            end = "<"
        elif magic in (b"\xa1\xb2\xc3\xd4", b"\xa1\xb2\x3c\x4d"):
            end = ">"
        else:
            out.faults.append("unknown capture format")
            return n
        if n < 24:
            out.faults.append("truncated file header")
            return n
        state["nano"] = magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")
        state["link"] = struct.unpack_from(end + "I", buf, 20)[0] & 0x0FFFFFFF
        state["end"], pos = end, 24
    nano, link = state["nano"], state["link"]
    rec = struct.Struct(state["end"] + "IIII")
    while pos < n:
        if pos + 16 > n:
            if not more:
                out.faults.append(f"truncated record header at byte {at + pos}")
            return pos
        sec, frac, incl, _orig = rec.unpack_from(buf, pos)
        if pos + 16 + incl > n:      # where the next record begins is not known
            if not more:
                out.faults.append(f"truncated record at byte {at + pos}")
            return pos
        out.add(at + pos, pos + 16, incl, sec * 1_000_000 + (frac // 1000 if nano else frac), link)
        pos += 16 + incl
        if len(out.offsets) >= SLICE:
            yield
    return pos


def _tsresol_divisor(opt: int) -> tuple[int, int]:
    """(multiplier, divisor) turning pcapng ticks into microseconds:
    us = ticks * 10**6 // ticks_per_second."""
    per_sec = 2 ** (opt & 0x7F) if opt & 0x80 else 10 ** (opt & 0x7F)
    return 1_000_000, per_sec


def _interface(buf: bytes, end: str, body: int, stop: int) -> tuple[int, int, int]:
    """(link, multiplier, divisor) of an interface block's body."""
    link = struct.unpack_from(end + "H", buf, body)[0]
    mult, div = 1, 1  # default resolution: microseconds (ticks = us)
    opt = body + 8
    while opt + 4 <= stop:
        code, olen = struct.unpack_from(end + "HH", buf, opt)
        if code == 0:
            break
        if code == 9 and olen >= 1 and opt + 5 <= stop:
            mult, div = _tsresol_divisor(buf[opt + 4])
        opt += 4 + ((olen + 3) & ~3)
    return link, mult, div


# The least body of the pcapng blocks that are read: interface, packets.
_LEAST_BODY = {1: 8, 6: 20, 3: 4}


def _frame_pcapng(buf: bytes, out: _Records, state: dict, more: bool = False):
    """Records of a pcapng buffer, as ``_frame_pcap``. ``state`` holds the section's byte
    order and its interfaces so far."""
    at, n, pos = state.setdefault("at", 0), len(buf), 0
    end = state.setdefault("end", "<")
    ifaces = state.setdefault("ifaces", [])     # [link, multiplier, divisor]
    while pos < n:
        if pos + 12 > n:
            if not more:
                out.faults.append(f"truncated block at byte {at + pos}")
            return pos
        if buf[pos:pos + 4] == b"\x0a\x0d\x0d\x0a":
            end = "<" if buf[pos + 8:pos + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            ifaces = []
            state.update(end=end, ifaces=ifaces)
        btype, blen = struct.unpack_from(end + "II", buf, pos)
        if blen < 12 or pos + blen > n:
            if blen < 12 or not more:
                out.faults.append(f"truncated block at byte {at + pos}")
            return n if blen < 12 else pos
        body, stop = pos + 8, pos + blen - 4
        if stop - body < _LEAST_BODY.get(btype, 0):
            out.faults.append(f"short block at byte {at + pos}")
            if btype == 1:       # keeps the numbers of the interfaces after it
                ifaces.append([-1, 1, 1])
        elif btype == 1:
            ifaces.append(list(_interface(buf, end, body, stop)))
        elif btype == 6:  # enhanced packet
            iface, hi, lo, incl, _orig = struct.unpack_from(end + "IIIII", buf, body)
            if iface < len(ifaces):
                link, mult, div = ifaces[iface]
                out.add(at + pos, body + 20, min(incl, stop - body - 20),
                        ((hi << 32) | lo) * mult // div, link)
            else:
                out.faults.append(f"packet for unknown interface at byte {at + pos}")
        elif btype == 3:  # simple packet: no time stamp
            orig = struct.unpack_from(end + "I", buf, body)[0]
            link = ifaces[0][0] if ifaces else LINK_ETHERNET
            out.add(at + pos, body + 4, min(orig, stop - body - 4), 0, link)
        pos += blen
        if len(out.offsets) >= SLICE:
            yield
    return pos


def framing(head: bytes):
    """The framing function of a file that begins with ``head``."""
    return _frame_pcapng if head[:4] == b"\x0a\x0d\x0d\x0a" else _frame_pcap


def frame_records(buf: bytes, state: dict | None = None, first: int = 0):
    """Slices of a capture's records: the same object again and again, its lists
    filled anew; faults add up in it. With a ``state`` the buffer is a range of whole
    records, the first of them number ``first``."""
    out = _Records()
    out.first = first
    frame = framing(buf) if state is None else (_frame_pcapng if "ifaces" in state else _frame_pcap)
    for _ in frame(buf, out, {} if state is None else state):
        yield out
        out.next_slice()
    yield out


# --- vectorised header decode ------------------------------------------------

def _u8(arr, idx, valid):
    safe = np.where(valid, idx, 0)
    return arr[safe].astype(np.int64)


def _be16(arr, idx, valid):
    return (_u8(arr, idx, valid) << 8) | _u8(arr, idx + 1, valid)


def decode(buf: bytes, capture_id: str) -> pd.DataFrame:
    """All rows of one capture as one ``PARSED`` frame."""
    return pd.concat(list(decode_slices(buf, capture_id)), ignore_index=True)


def _empty_row(capture_id: str, error: str | None, pkt_no: int | None = None) -> pd.DataFrame:
    row = dict.fromkeys(PARSED.fieldNames()) | {
        "capture_id": capture_id, "error": error, "pkt_no": pkt_no}
    return pd.DataFrame([row]).astype(object)


def decode_slices(buf: bytes, capture_id: str):
    """``PARSED`` frames of one capture: its packets slice by slice, then a row
    for its faults and, without any packet, one that names it."""
    packets, error, n = 0, None, 0
    try:
        for rec in frame_records(buf):
            frame = _decode_slice(buf, capture_id, rec)
            packets += len(frame)
            error, n = rec.error, rec.first + len(rec.offsets)
            if len(frame):
                yield frame
    except Exception as e:  # noqa: BLE001 - one bad file must not end the job
        error = f"cannot be decoded: {type(e).__name__}: {e}"
    if error is not None:
        yield _empty_row(capture_id, error, n)
    if not packets:
        yield _empty_row(capture_id, None)


def _decode_slice(buf: bytes, capture_id: str, rec: _Records) -> pd.DataFrame:
    """The IPv4 packets of a slice of records."""
    arr = np.frombuffer(buf, dtype=np.uint8)
    if len(arr) == 0:
        arr = np.zeros(1, dtype=np.uint8)
    off = np.asarray(rec.offsets, dtype=np.int64)
    length = np.asarray(rec.lengths, dtype=np.int64)
    link = np.asarray(rec.links, dtype=np.int64)
    n = len(off)
    end = off + length
    pkt_no = rec.first + np.arange(n, dtype=np.int64)

    # network-layer offset and ethertype by link type
    ip = np.full(n, -1, dtype=np.int64)
    eth = link == LINK_ETHERNET
    et_pos = off + 12
    ok = eth & (et_pos + 2 <= end)
    ethertype = np.where(ok, _be16(arr, et_pos, ok), -1)
    # up to two VLAN tags (802.1Q / 802.1ad)
    for _ in range(2):
        tagged = ok & np.isin(ethertype, (0x8100, 0x88A8)) & (et_pos + 6 <= end)
        et_pos = np.where(tagged, et_pos + 4, et_pos)
        ethertype = np.where(tagged, _be16(arr, et_pos, tagged), ethertype)
    ip = np.where(eth & (ethertype == 0x0800), et_pos + 2, ip)
    raw = np.isin(link, (LINK_RAW, LINK_RAW_ALT))
    ip = np.where(raw, off, ip)
    sll = link == LINK_SLL
    sll_ok = sll & (off + 16 <= end)
    ip = np.where(sll_ok & (_be16(arr, off + 14, sll_ok) == 0x0800), off + 16, ip)
    null = link == LINK_NULL
    null_ok = null & (off + 4 <= end)
    fam = _u8(arr, off, null_ok) | (_u8(arr, off + 3, null_ok))
    ip = np.where(null_ok & (fam == 2), off + 4, ip)

    has_ip = (ip >= 0) & (ip + 20 <= end)
    version = _u8(arr, ip, has_ip) >> 4
    v4 = has_ip & (version == 4)
    ihl = (_u8(arr, ip, v4) & 0x0F) * 4
    total_len = _be16(arr, ip + 2, v4)
    proto = _u8(arr, ip + 9, v4)
    frag = _be16(arr, ip + 6, v4) & 0x1FFF
    l4 = ip + ihl
    has_l4 = v4 & (frag == 0) & (ihl >= 20)
    tcp = has_l4 & (proto == 6) & (l4 + 14 <= end)
    udp = has_l4 & (proto == 17) & (l4 + 4 <= end)
    ports_ok = tcp | udp
    sport = np.where(ports_ok, _be16(arr, l4, ports_ok), 0)
    dport = np.where(ports_ok, _be16(arr, l4 + 2, ports_ok), 0)
    flags = np.where(tcp, _u8(arr, l4 + 13, tcp), 0)

    def ip_text(base):
        parts = [_u8(arr, base + k, v4).astype(str) for k in range(4)]
        return np.char.add(np.char.add(np.char.add(np.char.add(parts[0], "."), parts[1]), "."),
                           np.char.add(np.char.add(parts[2], "."), parts[3])) if n else np.array([], str)

    src = ip_text(ip + 12)
    dst = ip_text(ip + 16)
    keep = v4
    return pd.DataFrame({
        "capture_id": capture_id,
        "pkt_no": pkt_no[keep],
        "ts_us": np.asarray(rec.ts_us, dtype=np.int64)[keep] if n else np.array([], np.int64),
        "src_ip": src[keep] if n else np.array([], str),
        "dst_ip": dst[keep] if n else np.array([], str),
        "proto": proto[keep].astype(np.int32),
        "src_port": sport[keep].astype(np.int32),
        "dst_port": dport[keep].astype(np.int32),
        "ip_len": total_len[keep].astype(np.int64),
        "tcp_flags": flags[keep].astype(np.int32),
        "error": None,
    })


def _parse_batches(batches):
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            yield from decode_slices(bytes(content), path)


def parse_captures(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """binaryFile rows -> ``PARSED`` rows. The bytes of a file above ``max_bytes``
    are not read: it yields an error row (S8)."""
    fits = files.filter(F.col("length") <= max_bytes).select("path", "content") \
        .mapInPandas(_parse_batches, PARSED)
    message = F.concat(F.lit("capture of "), F.col("length").cast("string"),
                       F.lit(f" bytes is above the limit of {max_bytes}"))
    large = files.filter(F.col("length") > max_bytes).select("path", message.alias("m"))
    rows = [F.explode(F.array("m", F.lit(None).cast("string"))).alias("error"),
            F.col("path").alias("capture_id")]
    large = large.select(*rows).select(*[
        F.col(f.name) if f.name in ("capture_id", "error") else F.lit(None).cast(f.dataType).alias(f.name)
        for f in PARSED.fields])
    return fits.unionByName(large)


def split_errors(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packets, faults) of a parsed frame (S15). A capture without packets is in
    the first as a row of nulls."""
    good = parsed.filter(F.col("error").isNull()).drop("error")
    bad = parsed.filter(F.col("error").isNotNull()).select("capture_id", "pkt_no", "error")
    return good, bad


def read_packets(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Packets of every accepted capture under ``path``, decoded at each use."""
    return split_errors(parse_captures(capture_files(spark, path), max_bytes))[0]


def decode_once(spark: SparkSession, path: str, out: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Decode the captures under ``path`` into a parquet table for every later job."""
    parse_captures(capture_files(spark, path), max_bytes).write.mode("overwrite").parquet(out)
    return spark.read.schema(PARSED).parquet(out)

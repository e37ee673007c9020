"""Byte-level capture builders used by the tests (no capture library)."""

from __future__ import annotations

import struct


def ipv4(src, dst, proto, payload, total_len=None):
    ihl = 5
    tl = total_len if total_len is not None else 20 + len(payload)
    hdr = struct.pack(">BBHHHBBH4s4s", (4 << 4) | ihl, 0, tl, 0, 0, 64, proto, 0,
                      bytes(int(x) for x in src.split(".")), bytes(int(x) for x in dst.split(".")))
    return hdr + payload


def tcp(sport, dport, flags):
    return struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 0, 0, 0)


def udp(sport, dport, data=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(data), 0) + data


def ether(payload, ethertype=0x0800, vlan=None):
    dst, src = b"\x00" * 6, b"\x11" * 6
    if vlan is not None:
        return dst + src + struct.pack(">HHH", 0x8100, vlan, ethertype) + payload
    return dst + src + struct.pack(">H", ethertype) + payload


def ipv6_frame():
    return ether(b"\x60" + b"\x00" * 39, ethertype=0x86DD)


def pcap(frames, big_endian=False, nano=False, link=1):
    """frames: list of (ts_seconds_int, frac, bytes)."""
    e = ">" if big_endian else "<"
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(e + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for sec, frac, data in frames:
        out += struct.pack(e + "IIII", sec, frac, len(data), len(data)) + data
    return out


def pcapng(frames, tsresol=None, big_endian=False):
    """frames: list of (ticks, bytes); one Ethernet interface."""
    e = ">" if big_endian else "<"

    def block(btype, body):
        pad = (-len(body)) % 4
        blen = 12 + len(body) + pad
        return struct.pack(e + "II", btype, blen) + body + b"\x00" * pad + struct.pack(e + "I", blen)

    shb = block(0x0A0D0D0A, struct.pack(e + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    opts = b""
    if tsresol is not None:
        opts = struct.pack(e + "HH", 9, 1) + bytes([tsresol]) + b"\x00" * 3 + struct.pack(e + "HH", 0, 0)
    idb = block(1, struct.pack(e + "HHI", 1, 0, 65535) + opts)
    out = shb + idb
    for ticks, data in frames:
        body = struct.pack(e + "IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data))
        body += data + b"\x00" * ((-len(data)) % 4)
        out += block(6, body)
    return out

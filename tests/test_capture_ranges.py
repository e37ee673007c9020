"""Captures in byte ranges: the same packets and faults for every span, in both formats."""

import random

import pytest

from pcap_bytes import ether, ipv4, ipv6_frame, pcap, pcapng, tcp, udp
from tidewatch.sources import capture as C
from tidewatch.sources import capture_ranges as R

COLUMNS = ["capture_id", "pkt_no", "ts_us", "src_ip", "dst_ip", "proto", "src_port", "dst_port", "ip_len",
           "tcp_flags", "error"]


def frames(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        payload = bytes(rng.randrange(256) for _ in range(rng.choice([0, 5, 300])))
        f = rng.choice([lambda: ether(ipv4("10.0.0.1", "10.0.0.2", 6, tcp(k % 60000, 80, 2) + payload)),
                        lambda: ether(ipv4("10.0.0.3", "8.8.8.8", 17, udp(53, k % 60000, payload)), vlan=3),
                        ipv6_frame])()
        out.append((k, k % 1000, f))
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("captures")
    some = frames(700, 1)
    ng = [(s * 1_000_000 + f, x) for s, f, x in some]
    files = {"a.pcap": pcap(some), "b.PCAP": pcap(some, big_endian=True, nano=True),
             "c.pcapng": pcapng(ng), "d.pcapng": pcapng(ng[:300], big_endian=True) + pcapng(ng[300:], tsresol=9),
             "cut.pcap": pcap(some)[:-7], "cut.pcapng": pcapng(ng)[:-5], "none.cap": pcap([]), "zero.pcap": b"",
             "junk.pcap": b"nonsense" * 50, "v6.pcap": pcap([(1, 0, ipv6_frame())] * 3),
             "torn.pcapng": pcapng(ng[:50]) + b"\x06\x00\x00\x00\x03\x00\x00\x00" + b"x" * 900,
             "large.pcap": pcap([(1, 0, ether(ipv4("1.2.3.4", "5.6.7.8", 17, udp(1, 2, b"y" * 5000))))] * 5)}
    for name, data in files.items():
        (d / name).write_bytes(data)
    (d / "notes.txt").write_bytes(b"not a capture")
    return str(d)


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("span", [600, 4096, 1 << 20])
def test_same_rows_as_whole_files(spark, folder, tmp_path, span):
    want = rows(C.decode_once(spark, folder, str(tmp_path / "whole")))
    got = rows(R.decode_split(spark, folder, str(tmp_path / "split"), span=span))
    assert len(want) > 2500 and got == want


def test_ranges_cover_each_file_once_and_are_dealt_out(spark, folder, tmp_path):
    files = C.capture_files(spark, folder).select("path")
    found = R.ranges(files, 4096).collect()
    by_file = {}
    for r in found:
        if r["start"] is not None:
            by_file.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["start"], r["stop"], r["first"], r["packets"]))
    parts = sorted(by_file["a.pcap"])
    assert len(parts) > 20
    assert parts[0][0] == 0 and all(a[1] == b[0] and a[2] + a[3] == b[2] for a, b in zip(parts, parts[1:]))
    assert parts[-1][2] + parts[-1][3] == 700
    index = spark.createDataFrame(found, R.RANGES)
    assert R.decode_ranges(index, 64).rdd.getNumPartitions() == 64


def test_size_limit_and_empty_folder(spark, folder, tmp_path):
    limit = 20_000
    want = rows(C.decode_once(spark, folder, str(tmp_path / "whole"), limit))
    assert rows(R.decode_split(spark, folder, str(tmp_path / "split"), limit, 4096)) == want
    (tmp_path / "none").mkdir()
    assert R.decode_split(spark, str(tmp_path / "none"), str(tmp_path / "o")).count() == 0

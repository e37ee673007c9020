"""Byte-level capture fixtures, end to end through binaryFile + mapInPandas."""

import os
import random
import struct
import tempfile

from pyspark.sql import functions as F

from pcap_bytes import ether, ipv4, ipv6_frame, pcap, pcapng, tcp, udp
from tidewatch.operators import analyze as A
from tidewatch.sources import capture as C


def _frames():
    syn = ether(ipv4("10.0.0.1", "10.0.0.2", 6, tcp(1234, 80, 0x02)))
    ack = ether(ipv4("10.0.0.2", "10.0.0.1", 6, tcp(80, 1234, 0x10)))
    dns = ether(ipv4("10.0.0.3", "8.8.8.8", 17, udp(5353, 53, b"x" * 10)), vlan=7)
    return [(1, 0, syn), (1, 500, ack), (1, 900, syn), (2, 0, dns), (2, 1, ipv6_frame())]


def test_decode_variants():
    fr = _frames()
    for big in (False, True):
        for nano in (False, True):
            scale = 1000 if nano else 1
            frames = [(s, f * scale, d) for s, f, d in fr]
            pdf = C.decode(pcap(frames, big_endian=big, nano=nano), "x")
            assert len(pdf) == 4  # IPv6 ignored
            assert pdf.ts_us.tolist() == [1_000_000, 1_000_500, 1_000_900, 2_000_000]
            assert pdf.dst_port.tolist() == [80, 1234, 80, 53]
            assert pdf.tcp_flags.tolist() == [2, 16, 2, 0]
            assert pdf.error.isna().all()


def test_pcapng_and_truncation():
    fr = _frames()
    ng = pcapng([(1_000_000_000 * (i + 1), d) for i, (_, _, d) in enumerate(fr)], tsresol=9)
    pdf = C.decode(ng, "n")
    assert pdf.ts_us.tolist() == [1_000_000, 2_000_000, 3_000_000, 4_000_000]
    cut = C.decode(pcap(fr)[:-3], "t")
    assert cut.error.notna().sum() == 1 and cut.error.isna().sum() == 4
    assert C.decode(b"", "e").error.tolist() == ["unknown capture format", None]


def test_spark_capture_job(spark):
    d = tempfile.mkdtemp(prefix="caps-")
    with open(os.path.join(d, "a.PCAP"), "wb") as f:
        f.write(pcap(_frames()))
    with open(os.path.join(d, "b.pcapng"), "wb") as f:
        f.write(pcapng([(10, _frames()[0][2])]))
    with open(os.path.join(d, "empty.cap"), "wb") as f:
        f.write(pcap([]))
    with open(os.path.join(d, "notes.txt"), "wb") as f:
        f.write(b"not a capture")
    files = C.capture_files(spark, d)
    assert files.count() == 3
    parsed = C.parse_captures(files)
    good, bad = C.split_errors(parsed)
    assert bad.count() == 0
    assert good.filter("pkt_no IS NOT NULL").count() == 5
    assert [os.path.basename(r.capture_id) for r in good.filter("pkt_no IS NULL").collect()] == ["empty.cap"]
    caps = files.select(F.col("path").alias("capture_id"))
    v = {os.path.basename(r.capture_id): r for r in A.analyze(good, None, caps).collect()}
    assert v["empty.cap"].status == "Unknown"
    assert v["a.PCAP"].flows_analyzed == 3
    good, bad = C.split_errors(C.parse_captures(files, max_bytes=100))
    assert sorted(os.path.basename(r.capture_id) for r in bad.collect()) == ["a.PCAP", "b.pcapng"]
    assert "above the limit" in bad.first().error
    assert good.count() == 3 and good.filter("pkt_no IS NOT NULL").count() == 0
    listing = C.capture_listing(spark, d)
    assert listing.filter("accepted").count() == 3


def _block(btype, body):
    size = 12 + len(body)
    return struct.pack("<II", btype, size) + body + struct.pack("<I", size)


def test_bad_records_are_skipped_and_the_rest_is_kept():
    frame = _frames()[0][2]
    good = pcapng([(10, frame), (20, frame)])
    late = struct.pack("<IIIII", 0, 0xFFFFFFFF, 0xFFFFFFFF, len(frame), len(frame)) + frame + b"\0" * 2
    tests = {
        "short block": _block(6, b""),                                  # no packet header
        "unknown interface": _block(6, struct.pack("<IIIII", 7, 0, 0, 0, 0)),
        "short block ": _block(3, b""),
    }
    for name, extra in tests.items():
        pdf = C.decode(good + extra + _block(6, struct.pack("<IIIII", 0, 0, 30, len(frame), len(frame))
                                             + frame + b"\0" * (-len(frame) % 4)), "x")
        assert name.strip() in pdf.error.dropna().tolist()[0]
        assert pdf.ts_us.dropna().tolist() == [10, 20, 30]
    wide = pcapng([], tsresol=0)     # whole seconds: the stamp overflows
    pdf = C.decode(wide + _block(6, late), "x")
    assert "time stamp" in pdf.error.dropna().tolist()[0] and pdf.pkt_no.notna().sum() == 1
    # an interface block that is too short keeps the numbers of those after it
    idb = _block(1, struct.pack("<HHI", 1, 0, 65535))
    two = good[:28] + _block(1, b"") + idb + _block(6, struct.pack(
        "<IIIII", 1, 0, 5, len(frame), len(frame)) + frame + b"\0" * (-len(frame) % 4))
    assert C.decode(two, "x").ts_us.dropna().tolist() == [5]


def test_random_bytes_never_raise():
    rng = random.Random(0)
    frames = _frames()
    for seed in (pcap(frames), pcapng([(k, d) for k, (_, _, d) in enumerate(frames)], tsresol=6)):
        for _ in range(300):
            data = bytearray(seed[:rng.randint(0, len(seed))])
            for _ in range(rng.randint(0, 6)):
                if data:
                    data[rng.randrange(len(data))] = rng.randrange(256)
            pdf = C.decode(bytes(data), "x")
            assert len(pdf) >= 1 and set(pdf.capture_id) == {"x"}


def test_slices_are_one_capture(monkeypatch):
    frames = [(k, 0, _frames()[0][2]) for k in range(25)]
    whole = C.decode(pcap(frames), "x")
    monkeypatch.setattr(C, "SLICE", 4)
    parts = list(C.decode_slices(pcap(frames), "x"))
    assert len(parts) == 7
    assert C.decode(pcap(frames), "x").equals(whole) and whole.pkt_no.tolist() == list(range(25))


def test_a_fault_in_the_decoder_is_an_error_row(monkeypatch):
    def broken(*_):
        raise RuntimeError("no")
    monkeypatch.setattr(C, "_decode_slice", broken)
    assert C.decode(pcap(_frames()), "x").error.tolist() == ["cannot be decoded: RuntimeError: no", None]


def test_job_decodes_once_and_names_every_capture(spark, tmp_path, capsys):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pcap").write_bytes(pcap(_frames()))
    (src / "empty.cap").write_bytes(pcap([]))
    (src / "bad.pcap").write_bytes(b"nonsense")
    verdicts, faults = A.analyze_captures(spark, str(src), str(tmp_path / "work"))
    got = {os.path.basename(r.capture_id): r.status for r in verdicts.collect()}
    assert got["empty.cap"] == got["bad.pcap"] == "Unknown" and got["a.pcap"] != "Unknown"
    assert [os.path.basename(r.capture_id) for r in faults.collect()] == ["bad.pcap"]
    verdicts.explain()
    assert "Python" not in capsys.readouterr().out
    # from bytes the default gives the empty capture a verdict as well
    direct = A.analyze(C.read_packets(spark, str(src)))
    assert {os.path.basename(r.capture_id) for r in direct.collect()} == {"a.pcap", "empty.cap", "bad.pcap"}

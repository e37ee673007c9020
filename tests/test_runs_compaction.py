"""The run history stays small: compaction changes no history, and no reader loses a file."""

import os

import pytest

from pcap_bytes import ether, ipv4, pcap, tcp
from tidewatch.operators import runs as RU
from tidewatch.streaming import capture_stream as ST


def files(spark, *names):
    return spark.createDataFrame([(f"/x/{n}.pcap",) for n in names], "path string")


def finished(spark, table, *names):
    out = spark.createDataFrame([(f"/x/{n}.pcap", "{}", None) for n in names],
                                "file_path string, result string, error string")
    runs = RU.read(spark, table).filter(f"filename IN ({', '.join(repr(n + '.pcap') for n in names)})")
    RU.upsert(spark, table, RU.finish(runs, out))


def state(df):
    return sorted((r.id, r.status, r.progress, r.created_at, r.completed_at, r.result) for r in df.collect())


def versions(path):
    return sorted(d for d in os.listdir(path) if d.startswith("version="))


def bases(path):
    return sorted(os.listdir(os.path.join(path, "_compacted")))


def filled(spark, table):
    for k in range(4):
        RU.upsert(spark, table, RU.queued(files(spark, f"a{k}", f"b{k}")))
    finished(spark, table, "a0", "b1")
    return state(RU.read(spark, table))


def test_history_is_equal_before_and_after(spark, tmp_path):
    table = str(tmp_path / "runs")
    RU.compact(spark, table)                        # nothing there
    want = filled(spark, table)
    RU.compact(spark, table, grace_s=0)
    assert state(RU.read(spark, table)) == want and versions(table) == []
    RU.compact(spark, table, grace_s=0)             # nothing new: the base stays
    assert state(RU.read(spark, table)) == want and len(bases(table)) == 1
    finished(spark, table, "b0")
    assert versions(table) == ["version=5"]         # numbers go on behind the folded ones
    assert {r.filename for r in RU.read(spark, table).filter("status = 'completed'").collect()} == {
        "a0.pcap", "b1.pcap", "b0.pcap"}
    want = state(RU.read(spark, table))
    RU.compact(spark, table, grace_s=0)
    assert state(RU.read(spark, table)) == want and versions(table) == [] and len(bases(table)) == 1
    RU.clear(spark, table)
    assert RU.read(spark, table).count() == 0


def test_a_reader_that_began_before_is_unharmed(spark, tmp_path):
    table = str(tmp_path / "runs")
    want = filled(spark, table)
    before = RU.read(spark, table)
    RU.compact(spark, table, grace_s=3600)
    between = RU.read(spark, table)
    assert len(versions(table)) == 5                # folded, and still there
    finished(spark, table, "a3")
    RU.compact(spark, table, grace_s=3600)
    assert len(bases(table)) == 2
    assert state(before) == want == state(between)


def test_a_broken_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "runs")
    want = filled(spark, table)
    real = RU._newest

    def broken(versions_):
        raise RuntimeError("lost")
    monkeypatch.setattr(RU, "_newest", broken)
    with pytest.raises(RuntimeError):
        RU.compact(spark, table, grace_s=0)
    monkeypatch.setattr(RU, "_newest", real)
    # rows written, the manifest not: the base does not count
    half = f"{table}/_compacted/base=99999999999999999999-x/rows"
    RU._newest(RU._written(spark, table)).limit(1).write.parquet(half)
    assert state(RU.read(spark, table)) == want and len(versions(table)) == 5
    RU.compact(spark, table, grace_s=0)
    assert state(RU.read(spark, table)) == want and versions(table) == []


def test_a_version_written_again_after_it_was_folded_is_kept(spark, tmp_path):
    table = str(tmp_path / "runs")
    RU.upsert(spark, table, RU.queued(files(spark, "a")), 7)
    RU.compact(spark, table, grace_s=3600)
    RU.upsert(spark, table, RU.queued(files(spark, "a", "b")), 7)
    base = RU._bases(spark, table)[-1][0]
    os.utime(f"{base}/manifest/_SUCCESS", (1, 1))   # an old base that holds version 7 as it was
    RU.compact(spark, table, grace_s=3600)
    assert versions(table) == ["version=7"]
    assert {r.filename for r in RU.read(spark, table).collect()} == {"a.pcap", "b.pcap"}


def test_versions_of_several_streams(spark, tmp_path):
    table = str(tmp_path / "runs")
    for v in (5 << 31, 3, (5 << 31) + 1):
        RU.upsert(spark, table, RU.queued(files(spark, f"f{v}")), v)
    RU.compact(spark, table, grace_s=0)
    RU.upsert(spark, table, RU.queued(files(spark, "late")), 4)     # a lower number, later
    assert RU.read(spark, table).count() == 4
    RU.upsert(spark, table, RU.queued(files(spark, "next")))
    assert f"version={(5 << 31) + 2}" in versions(table)


def test_a_stream_compacts_its_history(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for name in ("one", "two"):
        (src / f"{name}.pcap").write_bytes(pcap([(1, 0, ether(ipv4("10.0.0.1", "10.0.0.2", 6, tcp(1, 80, 2))))]))
        ST.start(spark, str(src), out, checkpoint=str(tmp_path / "c"), available_now=True,
                 compact_every=1).awaitTermination()
    assert len(bases(f"{out}/runs")) == 2 and len(versions(f"{out}/runs")) == 4     # within the grace
    assert {r.filename: r.status for r in ST.runs(spark, out).collect()} == {
        "one.pcap": "completed", "two.pcap": "completed"}

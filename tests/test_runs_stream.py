"""Runs table lifecycle and the capture stream: nothing lost, nothing twice."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pcap_bytes import ether, ipv4, pcap, tcp
from tidewatch.operators import analyze as AN
from tidewatch.operators import runs as RU
from tidewatch.streaming import capture_stream as ST

FRAME = ether(ipv4("10.0.0.1", "10.0.0.2", 6, tcp(1, 80, 0x18)))
GOOD = pcap([(1, i * 100000, FRAME) for i in range(5)])


def test_runs_lifecycle(spark, tmp_path):
    table = str(tmp_path / "runs")
    assert RU.read(spark, table).count() == 0
    files = spark.createDataFrame([("/x/a.pcap",), ("/x/b.pcap",)], "path string")
    RU.upsert(spark, table, RU.queued(files))
    runs = RU.read(spark, table)
    assert runs.count() == 2
    out = spark.createDataFrame([("/x/a.pcap", '{"status":"Normal Traffic"}', None),
                                 ("/x/b.pcap", None, "bad file")],
                                "file_path string, result string, error string")
    RU.upsert(spark, table, RU.finish(runs, out))
    st = {r.filename: r.status for r in RU.read(spark, table).collect()}
    assert st == {"a.pcap": "completed", "b.pcap": "failed"}
    rid = RU.read(spark, table).filter(F.col("filename") == "a.pcap").first().id
    assert RU.lookup(RU.read(spark, table), rid).first().outcome == "ready"
    assert RU.lookup(RU.read(spark, table), "nope").first().outcome == "not_found"
    assert RU.history(RU.read(spark, table)).count() == 2
    RU.clear(spark, table)
    assert RU.read(spark, table).count() == 0
    RU.upsert(spark, table, RU.queued(files))
    assert RU.read(spark, table).count() == 2


def test_a_version_written_again_replaces_itself_only(spark, tmp_path):
    table = str(tmp_path / "runs")
    one, two = (spark.createDataFrame([(f"/x/{n}.pcap",)], "path string") for n in "ab")
    RU.upsert(spark, table, RU.queued(one), 0)
    RU.upsert(spark, table, RU.queued(two), 1)
    RU.upsert(spark, table, RU.queued(two), 1)
    assert sorted(r.filename for r in RU.read(spark, table).collect()) == ["a.pcap", "b.pcap"]


def test_an_unreadable_table_raises_and_is_not_replaced(spark, tmp_path):
    table = tmp_path / "runs"
    RU.upsert(spark, str(table), RU.queued(spark.createDataFrame([("/x/a.pcap",)], "path string")), 0)
    (table / "version=0" / "part-broken.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        RU.read(spark, str(table)).collect()
    RU.upsert(spark, str(table), RU.queued(spark.createDataFrame([("/x/b.pcap",)], "path string")), 1)
    (table / "version=0" / "part-broken.parquet").unlink()
    assert RU.read(spark, str(table)).count() == 2


def _run(spark, src, out, ck, **more):
    ST.start(spark, str(src), str(out), checkpoint=str(ck), available_now=True, **more).awaitTermination()


def _names(rows):
    return {os.path.basename(r.capture_id): r for r in rows.collect()}


def test_stream_available_now_idempotent(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "one.pcap").write_bytes(GOOD)
    for ck in ("c", "c", "other"):       # again, then replayed from a new checkpoint
        _run(spark, src, out, tmp_path / ck)
        rows = ST.verdicts(spark, str(out)).collect()
        assert len(rows) == 1 and rows[0].flows_analyzed == 1
        assert [r.status for r in ST.runs(spark, str(out)).collect()] == ["completed"]


def test_later_batches_and_streams_keep_history(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "one.pcap").write_bytes(GOOD)
    _run(spark, src, out, tmp_path / "c")
    (src / "two.pcap").write_bytes(GOOD)
    _run(spark, src, out, tmp_path / "c")
    (src / "three.pcap").write_bytes(GOOD)
    _run(spark, src, out, tmp_path / "new")
    assert set(_names(ST.verdicts(spark, str(out)))) == {"one.pcap", "two.pcap", "three.pcap"}
    assert ST.runs(spark, str(out)).count() == 3


def test_every_capture_ends_in_one_run_row(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "good.pcap").write_bytes(GOOD)
    (src / "cut.pcap").write_bytes(GOOD[:-3])
    (src / "bad.pcap").write_bytes(b"nonsense")
    (src / "empty.cap").write_bytes(pcap([]))
    (src / "large.pcap").write_bytes(GOOD * 3)
    _run(spark, src, out, tmp_path / "c", max_bytes=2 * len(GOOD))
    runs = {r.filename: r for r in ST.runs(spark, str(out)).collect()}
    assert {n: r.status for n, r in runs.items()} == {
        "good.pcap": "completed", "cut.pcap": "failed", "bad.pcap": "failed",
        "empty.cap": "completed", "large.pcap": "failed"}
    assert "above the limit" in runs["large.pcap"].error and "truncated" in runs["cut.pcap"].error
    assert json.loads(runs["empty.cap"].result)["status"] == "Unknown"
    assert all(r.progress == 100 and r.completed_at is not None for r in runs.values())
    verdicts = _names(ST.verdicts(spark, str(out)))
    assert verdicts["cut.pcap"].flows_analyzed == 1 and verdicts["large.pcap"].status == "Unknown"


def test_a_crash_between_the_writes_is_made_good(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "one.pcap").write_bytes(GOOD)
    real = RU.finish

    def broken(*_):
        raise RuntimeError("lost")
    monkeypatch.setattr(ST.runs_op, "finish", broken)
    with pytest.raises(Exception):
        _run(spark, src, out, tmp_path / "c")
    assert [r.status for r in ST.runs(spark, str(out)).collect()] == ["queued"]
    monkeypatch.setattr(ST.runs_op, "finish", real)
    _run(spark, src, out, tmp_path / "c")
    assert [r.status for r in ST.runs(spark, str(out)).collect()] == ["completed"]
    assert ST.verdicts(spark, str(out)).count() == 1


POISON = 6666


def _poisoned(monkeypatch):
    """Scoring that raises on any flow from one port."""
    real = AN.label_flows

    def label_flows(flows, *more):
        ok = F.when(F.col("src_port") == POISON, F.raise_error(F.lit("poisoned flow"))) \
            .otherwise(F.col("src_port"))
        return real(flows.withColumn("src_port", ok.cast("int")), *more)
    monkeypatch.setattr(AN, "label_flows", label_flows)


def test_one_bad_capture_of_ten_fails_alone(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    bad = [ether(ipv4("10.0.0.1", "10.0.0.2", 6, tcp(port, 80, 0x18))) for port in (POISON, 5, 9)]
    for k in range(10):
        (src / f"f{k}.pcap").write_bytes(GOOD)
    (src / "f4.pcap").write_bytes(pcap([(1, i * 100000, f) for i, f in enumerate(bad)]))
    want = None
    for poisoned in (False, True):
        if poisoned:
            _poisoned(monkeypatch)
        _run(spark, src, out / str(poisoned), tmp_path / f"c{poisoned}")
        runs = {r.filename: r for r in ST.runs(spark, str(out / str(poisoned))).collect()}
        verdicts = _names(ST.verdicts(spark, str(out / str(poisoned))))
        assert len(runs) == len(verdicts) == 10
        if not poisoned:
            assert {r.status for r in runs.values()} == {"completed"}
            want = {n: v.asDict() for n, v in verdicts.items()}
    assert {n for n, r in runs.items() if r.status == "failed"} == {"f4.pcap"}
    failed = runs["f4.pcap"]
    assert "poisoned flow" in failed.error and "Traceback" in failed.error_details
    result = json.loads(failed.result)
    assert (result["status"], result["flows_analyzed"], result["attack_types"]) == ("Error during analysis", 3, [])
    for n, v in verdicts.items():
        if n != "f4.pcap":
            assert {c: x for c, x in v.asDict().items() if c != "analysis_time"} == {
                c: x for c, x in want[n].items() if c != "analysis_time"}


def test_all_bad_and_none_at_all(spark, monkeypatch):
    from tidewatch.schemas import PACKETS
    none = spark.createDataFrame([], PACKETS)
    assert AN.analyze_isolated(none).collect() == []
    captures = spark.createDataFrame([("a",), ("b",), ("c",)], "capture_id string")
    assert {r.status for r in AN.analyze_isolated(none, captures=captures).collect()} == {"Unknown"}

    def broken(*_):
        raise ValueError("no model")
    monkeypatch.setattr(AN, "label_flows", broken)
    got = AN.analyze_isolated(none, captures=captures).collect()
    assert sorted((r.capture_id, r.status, r.error, r.flows_analyzed) for r in got) == [
        (c, "Error during analysis", "no model", 0) for c in "abc"]


def test_no_output_yet(spark, tmp_path):
    assert ST.verdicts(spark, str(tmp_path / "none")).count() == 0
    assert ST.runs(spark, str(tmp_path / "none")).count() == 0

"""Live flows: equal to the flows of all packets at once, whatever the batches."""

import random

from pyspark.sql import functions as F

from tidewatch.operators import flows as fl
from tidewatch.schemas import FLOW_KEY, FLOWS, PACKETS
from tidewatch.streaming import live_flows as live

IDLE, DELAY = 1000, 300


def _packets(spark, rows):
    return spark.createDataFrame(rows, PACKETS)


def _traffic(n=400, seed=3):
    """Stamps rise with the numbers; one flow holds a third of all packets."""
    rng, rows, now = random.Random(seed), [], 0
    for k in range(n):
        now += rng.choice([0, 5, 40, 200, 200, 1500])
        port = 1 if k % 3 == 0 else rng.randint(2, 6)
        rows.append(("c", k, now, "1.1.1.1", "2.2.2.2", 6, port, 80, 40 + k % 7, rng.choice([2, 16, 24])))
    return rows


def _same(found, wanted):
    a, b = (sorted(df.collect(), key=lambda r: (r.src_port, r.first_pkt_no)) for df in (found, wanted))
    assert len(a) == len(b) and len(b) > 10
    for x, y in zip(a, b):
        for k in FLOWS.fieldNames():
            if isinstance(y[k], float):
                assert abs(x[k] - y[k]) <= 1e-9 * max(1.0, abs(y[k])), (k, x, y)
            else:
                assert x[k] == y[k], (k, x, y)


def _brute_sessions(rows):
    runs, last = {}, {}
    for r in rows:
        key = (r[6], last.get((r[6], "n"), 0))
        if r[6] in last and r[2] - last[r[6]] > IDLE:
            last[(r[6], "n")] = last.get((r[6], "n"), 0) + 1
            key = (r[6], last[(r[6], "n")])
        last[r[6]] = r[2]
        runs.setdefault(key, []).append(r)
    return sorted((k[0], v[0][1], len(v), (v[-1][2] - v[0][2]) / 1e6) for k, v in runs.items())


def test_sessions_end_after_an_idle_gap(spark):
    rows = _traffic()
    for span in (1, 7, 1 << 20):
        found = fl.flow_sessions(_packets(spark, rows), IDLE, span).collect()
        assert sorted((r.src_port, r.first_pkt_no, r.pkt_count, r.flow_duration) for r in found) == _brute_sessions(rows)


def test_live_flows_equal_the_batch_flows(spark, tmp_path):
    """Packets swapped within the allowed delay, in seven batches with an empty one."""
    rows, out, rng = _traffic(), str(tmp_path / "out"), random.Random(1)
    order = sorted(rows, key=lambda r: r[2] + rng.uniform(0, DELAY))
    cuts = [0, 50, 51, 51, 200, 210, 390, 400]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        live.advance(_packets(spark, order[a:b]), out, n, IDLE, DELAY, bucket_span=16)
        live.advance(_packets(spark, order[a:b]), out, n, IDLE, DELAY, bucket_span=16)     # run again
    some = live.flows(spark, out).count()
    live.finish(spark, out, len(cuts) - 1, IDLE)
    assert live.late_packets(spark, out).isEmpty()
    _same(live.flows(spark, out), fl.flow_sessions(_packets(spark, rows), IDLE))
    assert 0 < some < live.flows(spark, out).count()
    left = sorted(p.name for p in (tmp_path / "out" / "state").iterdir())
    assert left == ["batch=6", "batch=7"]


def test_late_packets_go_to_their_table(spark, tmp_path):
    rows, out = _traffic(60), str(tmp_path / "out")
    live.advance(_packets(spark, rows[10:]), out, 0, IDLE, DELAY)
    live.advance(_packets(spark, rows[:10]), out, 1, IDLE, DELAY)
    live.finish(spark, out, 2, IDLE)
    assert sorted(r.pkt_no for r in live.late_packets(spark, out).collect()) == list(range(10))
    assert live.flows(spark, out).agg(F.sum("pkt_count")).first()[0] == 50


def test_an_open_flow_is_one_row_whatever_its_packets(spark, tmp_path):
    out = str(tmp_path / "out")
    for n in range(3):
        rows = [("c", n * 100 + k, n * 1000 + k, "1.1.1.1", "2.2.2.2", 6, 1, 80, 60, 2) for k in range(100)]
        live.advance(_packets(spark, rows), out, n, 10_000, 0)
    state = spark.read.parquet(f"{out}/state/batch=2/open")
    assert state.count() == 1 and state.first()["n"] == 300
    assert live.flows(spark, out).isEmpty()


def test_a_stream_of_files_and_rows_without_a_number(spark, tmp_path):
    rows, src, out = _traffic(120), tmp_path / "in", str(tmp_path / "out")
    none = ("c", None, None, None, None, None, None, None, None, None)
    for n in range(3):
        _packets(spark, [*rows[40 * n:40 * n + 40], none]).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(PACKETS).parquet(str(src))
        live.start(stream, out, str(tmp_path / "ck"), IDLE, DELAY, available_now=True).awaitTermination()
    live.finish(spark, out, 3, IDLE)
    _same(live.flows(spark, out), fl.flow_sessions(_packets(spark, rows), IDLE))
    assert live.flows(spark, out).select(*FLOW_KEY, "first_pkt_no").distinct().count() == live.flows(spark, out).count()

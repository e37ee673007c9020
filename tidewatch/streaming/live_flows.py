"""Live flows: packets as they arrive, flows as they end (ST1).

A flow ends after an idle gap. Each micro-batch takes the packets in, moves the
watermark to the latest stamp less ``delay_us``, folds what lies at or before it into
the open flows and gives out those that can get no further packet:

    <out>/flows/batch=<n>        flows that ended (schema ``FLOWS``)
    <out>/late/batch=<n>         packets behind the watermark they met
    <out>/state/batch=<n>/open   a row for each open flow, whatever its packets
    <out>/state/batch=<n>/held   packets past the watermark
    <out>/state/batch=<n>/mark   the watermark

The state of a batch is made from that of the batch before and its own packets alone, and
``mark`` is written last, so a batch that is run again after a failure ends in the same
files. Older states are removed. Flows are cut into buckets of packets before they meet, so
one that holds a third of all packets is folded by many tasks.

Packets of a flow are folded in the order of their numbers as far as the watermark lets
them in; where stamps do not run backwards within a flow by more than ``delay_us`` and none
is late, the flows are those of ``flow_sessions`` over all packets at once. The watermark is
one for the whole stream, as Spark's own. Packets without a stamp or a number are no packets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flows as fl
from ..schemas import FLOWS, PACKETS
from ..session import path_exists

IDLE_US = 60_000_000
DELAY_US = 10_000_000


def _state(out: str, batch: int) -> str:
    return f"{out}/state/batch={batch}"


def _mark(spark: SparkSession, base: str) -> int | None:
    """The watermark of a state that was written to its end; None without one."""
    if not path_exists(spark, f"{base}/mark/_SUCCESS"):
        return None
    return spark.read.schema("mark long").parquet(f"{base}/mark").first()["mark"]


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def advance(batch: DataFrame, out: str, batch_id: int, idle_us: int = IDLE_US,
            delay_us: int = DELAY_US, last: bool = False,
            bucket_span: int = fl.DEFAULT_BUCKET_SPAN) -> None:
    """Take one batch of packets in. ``last``: no packet will follow, so all flows end."""
    spark, out = batch.sparkSession, out.rstrip("/")
    before, now = _state(out, batch_id - 1), _state(out, batch_id)
    mark = _mark(spark, before)
    if mark is None and batch_id > 0:
        raise FileNotFoundError(f"no state of batch {batch_id - 1} under {out}")
    packets = batch.select(*PACKETS.fieldNames()).filter("pkt_no IS NOT NULL AND ts_us IS NOT NULL")
    late = F.lit(False) if mark is None else F.col("ts_us") < mark
    packets.filter(late).write.mode("overwrite").parquet(f"{out}/late/batch={batch_id}")
    packets = packets.filter(~late)
    newest = packets.agg(F.max("ts_us")).first()[0]
    moved = [m for m in (mark, None if newest is None else newest - delay_us) if m is not None]
    mark_now = max(moved, default=-(1 << 62))
    if mark is not None:
        packets = packets.unionByName(spark.read.schema(PACKETS).parquet(f"{before}/held"))
    ready = F.lit(True) if last else F.col("ts_us") <= mark_now
    packets.filter(~ready).write.mode("overwrite").parquet(f"{now}/held")
    parts = fl.flow_parts(packets.filter(ready), bucket_span, idle_us).drop("bucket", "run")
    if mark is not None:
        parts = parts.unionByName(spark.read.schema(parts.schema).parquet(f"{before}/open"))
    merged = fl.merged_sessions(parts, idle_us)
    merged.write.mode("overwrite").parquet(f"{now}/merged")
    merged = spark.read.schema(merged.schema).parquet(f"{now}/merged")
    # the newest session of a flow may go on until the watermark is past its idle gap
    ended = F.lit(True) if last else F.col("last_ts") + idle_us < mark_now
    merged.filter(~ended).write.mode("overwrite").parquet(f"{now}/open")
    fl.finished(merged.filter(ended)).write.mode("overwrite").parquet(f"{out}/flows/batch={batch_id}")
    spark.createDataFrame([(mark_now,)], "mark long").coalesce(1) \
        .write.mode("overwrite").parquet(f"{now}/mark")
    _remove(spark, f"{now}/merged")
    _remove(spark, _state(out, batch_id - 2))


def flows(spark: SparkSession, out: str) -> DataFrame:
    """The flows that ended so far."""
    return _read(spark, f"{out.rstrip('/')}/flows", FLOWS)


def late_packets(spark: SparkSession, out: str) -> DataFrame:
    """The packets that came behind the watermark; no flow holds them."""
    return _read(spark, f"{out.rstrip('/')}/late", PACKETS)


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def start(packets: DataFrame, out: str, checkpoint: str, idle_us: int = IDLE_US,
          delay_us: int = DELAY_US, available_now: bool = False,
          processing_time: str = "30 seconds"):
    """Start the stream over a streaming table of packets (schema ``PACKETS``). ``out`` and
    ``checkpoint`` belong together: a new checkpoint needs a new ``out``."""
    w = packets.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, n: advance(batch, out, n, idle_us, delay_us))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


def finish(spark: SparkSession, out: str, batch_id: int, idle_us: int = IDLE_US) -> None:
    """End all flows after the last batch ``batch_id - 1`` of a stopped stream."""
    advance(spark.createDataFrame([], PACKETS), out, batch_id, idle_us, last=True)

"""Watch a folder for captures and analyse each new file as it lands (ST1).

``readStream.format('binaryFile')`` with the extension glob; ``foreachBatch``
decodes a micro-batch once into a written packets table, analyses that and writes
the verdicts and the run rows, each into the batch's own folder:

    <out>/packets/stream=<s>/batch=<n>    decoded packets and faults
    <out>/verdicts/stream=<s>/batch=<n>   one verdict per capture
    <out>/runs/version=<v>                one finished run per capture

A batch writes only its own folders, so a replayed batch or a crash between the
writes ends in the same files, and no history is read or rewritten. ``<s>`` is
taken from the checkpoint, so a stream restarted from a new checkpoint adds to the
history instead of replacing an older stream's batches. Readers take the newest
row of each capture.

Every file ends in a run row: a file that cannot be decoded to its end, that is
above the size limit or whose analysis raises is ``failed`` with its error, and takes
no other file of its batch with it; one without flows is ``completed`` with the verdict
``Unknown``.
"""

from __future__ import annotations

import os
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import analyze as analyze_op
from ..operators import runs as runs_op
from ..session import ensure_checkpoint_dir, path_exists
from ..sources import capture as cap

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
# Versions of one stream's runs: batches below this many, twice each.
_BATCHES = 1 << 30


def capture_stream(spark: SparkSession, folder: str,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """New capture files with their bytes, whatever their size."""
    reader = (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
              .option("pathGlobFilter", cap.extension_glob())
              .option("recursiveFileLookup", "true"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder)


def _batch_writer(out_path: str, stream: str, bundle, merge: str, max_bytes: int,
                  compact_every: int = 0):
    out_path = out_path.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = f"stream={stream}/batch={batch_id}"
        runs_path = f"{out_path}/runs"
        first = int(stream) * _BATCHES * 2 + 2 * batch_id
        files = batch.select("path")
        queued = runs_op.queued(files)
        runs_op.upsert(spark, runs_path, queued, first)
        decoded = f"{out_path}/packets/{part}"
        cap.parse_captures(batch, max_bytes).write.mode("overwrite").parquet(decoded)
        parsed = spark.read.schema(cap.PARSED).parquet(decoded)
        good, bad = cap.split_errors(parsed)
        verdicts = analyze_op.analyze_isolated(
            good, bundle, files.withColumnRenamed("path", "capture_id"), merge=merge)
        failed = bad.groupBy("capture_id").agg(F.min("error").alias("fault"))
        rows = verdicts.join(failed, "capture_id", "left") \
            .withColumn("error", F.coalesce("fault", "error")).drop("fault")
        made = f"{out_path}/verdicts/{part}"
        rows.write.mode("overwrite").parquet(made)
        done = spark.read.schema(rows.schema).parquet(made)
        text = analyze_op.verdict_json(done.drop("error", "error_details")) \
            .withColumnRenamed("capture_id", "file_path")
        outcome = done.select(F.col("capture_id").alias("file_path"), "error", "error_details") \
            .join(text, "file_path")
        runs_op.upsert(spark, runs_path, runs_op.finish(queued, outcome), first + 1)
        if compact_every and batch_id % compact_every == compact_every - 1:
            runs_op.compact(spark, runs_path)
    return write


def verdicts(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest verdict of each capture; none written yet gives no rows."""
    path = f"{out_path.rstrip('/')}/verdicts"
    if not path_exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("capture_id", T.StringType())]))
    rows = spark.read.parquet(path)
    row = F.struct(*[c for c in rows.columns if c not in ("stream", "batch")])
    newest = F.max_by(row, F.struct("analysis_time", "batch"))
    return rows.groupBy(F.col("capture_id").alias("_id")).agg(newest.alias("r")).select("r.*")


def runs(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest run row of each capture."""
    return runs_op.read(spark, f"{out_path.rstrip('/')}/runs")


def start(spark: SparkSession, folder: str, out_path: str, bundle=None,
          checkpoint: str | None = None, merge: str = "max", available_now: bool = False,
          processing_time: str | None = "30 seconds", max_bytes: int = cap.MAX_BYTES,
          compact_every: int = 500):
    """Start the stream; ``available_now=True`` processes what is there and stops. The run
    history is compacted after every ``compact_every`` batches (0: never)."""
    ckpt = checkpoint or os.path.join(ensure_checkpoint_dir(spark), "capture_stream")
    stream = str(zlib.crc32(ckpt.encode()) >> 1)
    w = (capture_stream(spark, folder).writeStream
         .foreachBatch(_batch_writer(out_path, stream, bundle, merge, max_bytes, compact_every))
         .option("checkpointLocation", ckpt))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()

"""Large captures in pieces: many tasks per file, no file as one row.

A capture has no split points of its own, since where a record begins is only known
from the record before. So it is read twice. The first pass walks the record headers
of each file, a window of ``span`` bytes at a time, and writes a row per window: its byte
range, cut at record boundaries, the number of its first record and what a reader must
know to start there (byte order, link type, interfaces so far). The second pass deals
these ranges out, and every task reads and decodes its ranges alone.

Tasks read byte ranges through Arrow's file systems (local and mounted paths, HDFS, S3,
GCS, Azure). A path with another scheme is decoded whole, as ``capture.parse_captures``
does. The packets are the same either way, and for every ``span``.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import capture as cap

SPAN = 32 << 20
SCHEMES = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")
RANGES = ("path string, start long, stop long, first long, state string, "
          "packets long, error string")
_NAMES = ["path", "start", "stop", "first", "state", "packets", "error"]


def _opened(path: str):
    """A file open for reads at any place. Hadoop's ``file:/x`` and ``s3a:`` are Arrow's
    ``file:///x`` and ``s3:``."""
    uri = re.sub(r"^s3a:", "s3:", re.sub(r"^file:/+", "file:///", path))
    system, name = fs.FileSystem.from_uri(uri)
    return system.open_input_file(name)


def _walk(path: str, span: int):
    """The ranges of one file, then a row that ends it: all its records, its faults."""
    out, state, frame = cap._Records(), {}, None
    error, start, window = None, 0, b""
    try:
        with _opened(path) as f:
            size = f.size()
            while True:
                window += f.read_at(min(span, size - start - len(window)), start + len(window))
                more = start + len(window) < size
                frame = frame or cap.framing(window)
                state["at"] = start
                before, first = json.dumps(state), out.first
                walk = frame(window, out, state, more)
                try:
                    while True:
                        next(walk)
                        out.next_slice()        # only their number counts here
                except StopIteration as end:
                    done = end.value
                out.next_slice()
                if done:
                    yield (path, start, start + done, first, before, out.first - first, None)
                if not more or out.faults and out.faults[-1].startswith(("unknown capture", "truncated")):
                    break                       # the end, or what follows cannot be framed
                start, window = start + done, window[done:]
        error = out.error
    except Exception as e:  # noqa: BLE001 - one bad file must not end the job
        error = f"cannot be decoded: {type(e).__name__}: {e}"
    yield (path, None, None, out.first, None, out.first, error)


def ranges(files: DataFrame, span: int = SPAN) -> DataFrame:
    """(path, start, stop, first, state, packets, error): the ranges of each file of
    ``files`` (column ``path``), and a row without a range that ends each file."""
    def run(batches):
        for pdf in batches:
            for path in pdf["path"]:
                rows = []
                for row in _walk(path, span):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=_NAMES, dtype=object)
                        rows = []
                yield pd.DataFrame(rows, columns=_NAMES, dtype=object)
    return files.select("path").mapInPandas(run, RANGES)


def _decoded(batches):
    for pdf in batches:
        for r in pdf.itertuples():
            with _opened(r.path) as f:
                buf = f.read_at(int(r.stop - r.start), int(r.start))
            state = json.loads(r.state)
            # the range with the file header has no state yet
            known = state if "end" in state else None
            for rec in cap.frame_records(buf, known, int(r.first)):
                frame = cap._decode_slice(buf, r.path, rec)
                if len(frame):
                    yield frame


def decode_ranges(found: DataFrame, tasks: int | None = None) -> DataFrame:
    """Packets of the ranges of ``found`` (a written table), dealt over the tasks."""
    work = found.filter(F.col("start").isNotNull() & (F.col("packets") > 0))
    work = work.repartition(tasks or max(1, work.count()), "path", "start")
    return work.mapInPandas(_decoded, cap.PARSED)


def decode_split(spark: SparkSession, path: str, out: str, max_bytes: int | None = None,
                 span: int = SPAN) -> DataFrame:
    """``capture.decode_once``, with large captures in pieces: a parquet table of
    ``PARSED`` rows at ``out``. Without ``max_bytes`` files of any size are read."""
    files = cap.capture_files(spark, path).select("path", "length")
    fits = files if max_bytes is None else files.filter(F.col("length") <= max_bytes)
    scheme = F.coalesce(F.nullif(F.regexp_extract("path", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit("")),
                        F.lit("file"))
    near = fits.filter(scheme.isin(*SCHEMES))
    index = f"{out.rstrip('/')}-ranges"
    ranges(near, span).write.mode("overwrite").parquet(index)
    found = spark.read.schema(RANGES).parquet(index)
    decode_ranges(found).write.mode("overwrite").parquet(out)
    packets = spark.read.schema(cap.PARSED).parquet(out)
    # faults, files without packets, files above the limit and those of other schemes
    ends = found.filter(F.col("start").isNull())
    none = ends.join(packets.select("capture_id").distinct(),
                     F.col("path") == F.col("capture_id"), "left_anti")
    other = cap.capture_files(spark, path).filter(~scheme.isin(*SCHEMES) if max_bytes is None else
                                                  ~scheme.isin(*SCHEMES) | (F.col("length") > max_bytes))
    limit = max_bytes if max_bytes is not None else (1 << 62)

    def named(df, **columns):
        return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                           for f in cap.PARSED.fields])
    rest = named(none, capture_id=F.col("path")).unionByName(
        named(ends.filter("error IS NOT NULL"), capture_id=F.col("path"), pkt_no=F.col("first"),
              error=F.col("error"))).unionByName(cap.parse_captures(other, limit))
    made = f"{index}-rest"
    rest.write.mode("overwrite").parquet(made)
    spark.read.schema(cap.PARSED).parquet(made).write.mode("append").parquet(out)
    return spark.read.schema(cap.PARSED).parquet(out)


"""The ``analysis_runs`` table: one row per submitted capture (C6, J7, O4,
U5, F8, F10).

Stored as parquet in the shared folder, as versions: a change appends rows in a
partition of its own and a read takes the newest version of each id. Nothing that
was written is read or rewritten to make a change, so a failed or repeated write
cannot lose history and costs as much as its own rows.

``compact`` folds the versions into a base table, so that a read does not list and group
all that were ever written:

    <path>/version=<v>                     a version, as written
    <path>/_compacted/base=<b>/rows        the newest row of each id, with its version
    <path>/_compacted/base=<b>/manifest    the versions it holds; written last

A read takes the newest base that has a manifest and all versions that are still there.
A version that is read beside a base that holds it changes nothing, so the versions can
go at any time later: they go once a base that holds them is older than a reader can be.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ANALYSIS_RUNS
from ..session import path_exists


def run_id(path_col="file_path"):
    """Deterministic run id from the stored path (F10): rerunning the same
    file gives the same id, so writes are idempotent."""
    return F.sha2(F.col(path_col), 256).substr(1, 32)


def queued(files: DataFrame) -> DataFrame:
    """New run rows for capture files (``path`` column): status queued."""
    return files.select(
        run_id("path").alias("id"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.col("path").alias("file_path"),
        F.lit("queued").alias("status"),
        F.lit(0).alias("progress"),
        F.current_timestamp().alias("created_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
        F.lit(None).cast("string").alias("result"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("error_details"),
    )


def finish(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Apply outcomes (``file_path, result, error`` and maybe ``error_details``) to run
    rows (C6): an error gives ``failed``, otherwise ``completed``; progress 100 either way."""
    more = F.col("error_details") if "error_details" in outcomes.columns else F.lit(None).cast("string")
    o = outcomes.select("file_path", F.col("result").alias("_res"), F.col("error").alias("_err"),
                        more.alias("_more"))
    j = runs.join(o, "file_path", "left")
    done = F.col("_res").isNotNull() | F.col("_err").isNotNull()
    return j.select(
        "id", "filename", "file_path",
        F.when(~done, F.col("status")).when(F.col("_err").isNotNull(), "failed")
        .otherwise("completed").alias("status"),
        F.when(done, 100).otherwise(F.col("progress")).alias("progress"),
        "created_at",
        F.when(done, F.current_timestamp()).otherwise(F.col("completed_at")).alias("completed_at"),
        F.coalesce("_res", "result").alias("result"),
        F.coalesce("_err", "error").alias("error"),
        F.coalesce("_more", "error_details").alias("error_details"),
    )


def _outcome():
    return (F.when(F.col("status").isNull(), "not_found")
            .when(F.col("status") == "completed", "ready")
            .when(F.col("status") == "failed", "failed")
            .otherwise("pending"))


def outcomes(runs: DataFrame) -> DataFrame:
    """Every run with the outcome a lookup would report."""
    return runs.select("id", "filename", "status", "progress", "error",
                       _outcome().alias("outcome"))


def lookup(runs: DataFrame, rid: str) -> DataFrame:
    """Run by id with its outcome (J7): ``not_found`` when absent, else
    ``ready`` for completed, ``failed`` or ``pending``."""
    spark = runs.sparkSession
    want = spark.createDataFrame([(rid,)], "id string")
    j = want.join(runs, "id", "left")
    return j.select(
        "id", "filename", "status", "progress", "result", "error",
        _outcome().alias("outcome"),
    )


def history(runs: DataFrame) -> DataFrame:
    """Brief columns, newest first (O4); ties by id."""
    return runs.select("id", "filename", "status", "created_at", "completed_at") \
        .orderBy(F.desc("created_at"), "id")


def stamp(col="created_at"):
    """Timestamp as ``yyyy-MM-dd HH:mm:ss`` text, only at output (F8)."""
    return F.date_format(F.col(col), "yyyy-MM-dd HH:mm:ss")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ANALYSIS_RUNS)


def clear(spark: SparkSession, path: str) -> None:
    """Empty the history (U5): overwrite all versions with an empty frame."""
    empty(spark).withColumn("version", F.lit(0).cast("long")) \
        .write.mode("overwrite").option("partitionOverwriteMode", "static") \
        .partitionBy("version").parquet(path)


def _newest(versions: DataFrame) -> DataFrame:
    row = F.struct(*ANALYSIS_RUNS.fieldNames(), "version")
    age = F.struct(F.coalesce("completed_at", "created_at"), "version")
    return versions.groupBy(F.col("id").alias("_id")).agg(F.max_by(row, age).alias("r")) \
        .select("r.*")


def newest(versions: DataFrame) -> DataFrame:
    """Of each id the row written last: by its time, then by version."""
    return _newest(versions).drop("version")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each run; no table yet is an empty one. Any other
    failure to read raises."""
    if not path_exists(spark, path):
        return empty(spark)
    return newest(_written(spark, path))


def _written(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest base and of all versions that are there, with their version."""
    schema = f"{_ddl()}, version long"
    rows = spark.read.schema(schema).parquet(path)
    bases = _bases(spark, path)
    return rows.unionByName(spark.read.schema(schema).parquet(f"{bases[-1][0]}/rows")) if bases else rows


def _listed(spark: SparkSession, folder: str, prefix: str, mark: str) -> list[tuple[str, int]]:
    """(folder, milliseconds of its ``mark`` file) of the whole ones under ``folder`` whose
    name starts with ``prefix``, by name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    out = []
    for found in fs.listStatus(where):
        name = found.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/{mark}")
        if name.startswith(prefix) and fs.exists(done):
            out.append((f"{folder}/{name}", fs.getFileStatus(done).getModificationTime()))
    return sorted(out)


def _bases(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    return _listed(spark, f"{path.rstrip('/')}/_compacted", "base=", "manifest/_SUCCESS")


def _manifest(spark: SparkSession, base: str) -> set[tuple[int, int]]:
    return {(r[0], r[1]) for r in spark.read.schema("version long, stamp long")
            .parquet(f"{base}/manifest").collect()}


def _delete(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def compact(spark: SparkSession, path: str, grace_s: float = 86_400) -> None:
    """Fold the versions that are there into a new base, and delete those that a base of at
    least ``grace_s`` seconds ago holds as well, so a reader that began before loses no file.
    A version written again since then stays until it is folded anew. May be broken off and
    run again at any place, beside readers and writers, by several callers at once. What a
    version holds that was folded is added to, no longer replaced, when it is written again."""
    path = path.rstrip("/")
    if not path_exists(spark, path):
        return
    found = _listed(spark, path, "version=", "_SUCCESS")
    stamps = {(int(name.rpartition("=")[2]), stamp): name for name, stamp in found}
    bases = _bases(spark, path)
    if stamps and not (bases and set(stamps) <= _manifest(spark, bases[-1][0])):
        base = f"{path}/_compacted/base={time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        _newest(_written(spark, path)).write.parquet(f"{base}/rows")
        spark.createDataFrame(list(stamps), "version long, stamp long").coalesce(1) \
            .write.parquet(f"{base}/manifest")
        bases = _bases(spark, path)
    old = [b for b, stamp in bases if stamp <= (time.time() - grace_s) * 1000]
    if old:
        held = set.union(*(_manifest(spark, b) for b in old)) & _manifest(spark, bases[-1][0])
        for key in held & set(stamps):
            _delete(spark, stamps[key])
        for b in old[:-1]:
            _delete(spark, b)


def _ddl() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ANALYSIS_RUNS.fields)


def upsert(spark: SparkSession, path: str, rows: DataFrame, version: int | None = None) -> None:
    """Put ``rows`` in as a version. Writing a version again replaces that version
    only; without a number the next free one is taken (one writer at a time)."""
    if version is None:
        version = 0
        if path_exists(spark, path):
            used = _written(spark, path).select("version")
            for base, _ in _bases(spark, path)[-1:]:
                used = used.union(spark.read.schema("version long").parquet(f"{base}/manifest"))
            last = used.agg(F.max("version")).first()[0]
            version = 0 if last is None else last + 1
    rows.select(*ANALYSIS_RUNS.fieldNames()).write.mode("overwrite") \
        .parquet(f"{path.rstrip('/')}/version={int(version)}")

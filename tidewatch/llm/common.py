"""Helpers shared by the operators: table readers and written intermediate tables."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the cluster's shared checkpoint folder and read it
    back. This cuts the lineage on storage every executor sees, so a lost
    executor costs a re-read, and gives the planner the table's real size."""
    spark = df.sparkSession
    path = shared_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def document_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Let Spark hand whole documents to Python in batches of about ``size`` bytes
    (a session setting; only ever lowered), so that what an executor holds at a
    time does not depend on how long its documents are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("b"))
    if now <= 0 or now > size:
        spark.conf.set(key, f"{size}b")


def small_side(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A written table as the small side of a join: broadcast where its counted
    rows are at most ``rows``, else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def id_crc_mod(doc_id: str, mod: int):
    """crc32 of the id as text, modulo ``mod`` (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def shingles_sql(words: str, width: int, each: str) -> str:
    """SQL for the array of ``each`` over a word array's ``width``-word
    shingles. A sequence shorter than ``width`` is one shingle, an empty one
    has none. ``words`` is bound to a lambda variable so that it is evaluated
    once a row, not once a shingle; in ``each``, ``{s}`` is the shingle text."""
    body = each.format(s=f"array_join(slice(w, i, {width}), ' ')")
    return (f"transform(array({words}), w -> CASE WHEN size(w) > 0 THEN "
            f"transform(sequence(1, greatest(size(w) - {width - 1}, 1)), i -> {body}) END)[0]")


def int_matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of integer lists as a matrix of ``width`` columns at least; shorter rows
    end in zeros."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat[ends[0]:ends[-1]]
    return out

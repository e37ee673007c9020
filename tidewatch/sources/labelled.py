"""Labelled per-class CSV folders.

Layout: ``<root>/<name>/<name>_dataset.csv`` with a header row, and a
``<name>_labels.csv`` next to it that must exist but is only counted (K14).
Every row of a folder takes the folder name as its ``Label``.

Folders are read one by one, because one read over all of them binds
columns by position to the first file's header; the reads are then unioned
by name. File splits do the chunking (S5), so a 100 GB file is read by many
tasks at once.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.prepare import LABEL, bad_cells, union_by_name

DATA_SUFFIX = "_dataset.csv"
LABELS_SUFFIX = "_labels.csv"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(folder, name, path, length) of files one level below ``root``. The
    binaryFile source lists without reading bytes when ``content`` is not
    selected."""
    files = (spark.read.format("binaryFile").load(os.path.join(root, "*", "*"))
             .select("path", "length"))
    return files.select(
        F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("folder"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        "path", "length",
    ).filter(~F.col("folder").startswith("."))


def discover(spark: SparkSession, root: str, require_labels: bool = True) -> DataFrame:
    """Complete datasets (S2, S4): folders with a data file, and with a labels
    file when ``require_labels`` (J5: left semi join on folder)."""
    files = list_files(spark, root)
    data = files.filter(F.col("name") == F.concat("folder", F.lit(DATA_SUFFIX)))
    if require_labels:
        labels = files.filter(F.col("name") == F.concat("folder", F.lit(LABELS_SUFFIX)))
        data = data.join(labels.select("folder"), "folder", "left_semi")
    return data.select("folder", "path", "length")


def label_row_counts(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    """Rows in each labels file (counted, never joined; K14)."""
    frames = [spark.read.option("header", True).csv(os.path.join(root, f, f + LABELS_SUFFIX))
              .agg(F.count(F.lit(1)).alias("label_rows")).withColumn("folder", F.lit(f))
              for f in folders]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def dataset_audit(spark: SparkSession, root: str, require_labels: bool = True) -> DataFrame:
    """(folder, path, length, label_rows) of the complete datasets (S2, S4): what a
    load will read, with the rows of each labels file; null without one."""
    found = discover(spark, root, require_labels)
    labelled = [r["folder"] for r in discover(spark, root).select("folder").collect()]
    if not labelled:
        return found.withColumn("label_rows", F.lit(None).cast("long"))
    return found.join(label_row_counts(spark, root, labelled), "folder", "left")


def read_dataset(spark: SparkSession, path: str, label: str, schema=None,
                 infer: bool = True, limit: int | None = None) -> DataFrame:
    """One folder's data with its label (P1); ``limit`` keeps the first rows
    of the file in file order (W3, K13)."""
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", infer)
    df = reader.csv(path)
    if limit is not None:
        df = first_rows_in_file_order(df, limit)
    return df.withColumn(LABEL, F.lit(label))


def first_rows_in_file_order(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of a file scan in file order, without a sort or
    a shuffle of the rows.

    A scan split is read in file order by one task, and its rows are
    contiguous in that task, so ``monotonically_increasing_id`` minus the
    split's smallest id is the row's index inside the split. One count per
    split (a row each, read in order up to the cut) finds the split in which row
    ``n`` lies; a filter on file, split and row keeps what comes before, so rows
    past the cut are dropped as they are read and none is joined."""
    cols = df.columns
    tagged = df.select(
        *cols,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    splits = tagged.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first")).orderBy("_file", "_block")
    before = 0
    for s in splits.toLocalIterator():
        if before + s["_n"] >= n:
            file, block = F.col("_file"), F.col("_block")
            inside = (block == s["_block"]) & (F.col("_mid") < s["_first"] + n - before)
            keep = (file < s["_file"]) | ((file == s["_file"]) & ((block < s["_block"]) | inside))
            return tagged.filter(keep).select(*cols)
        before += s["_n"]
    return df


def load_labelled(spark: SparkSession, root: str, limit: int | None = None,
                  only: str | None = None, schema=None, infer: bool = True,
                  require_labels: bool = True) -> DataFrame | None:
    """All complete datasets under ``root`` unioned by name.

    ``limit`` is per folder, or split evenly over folders when no single
    folder is named (W3). Missing cells are null here; ``prepare.clean``
    turns them into 0. Returns None when nothing qualifies.
    """
    found = discover(spark, root, require_labels)
    if only is not None:
        found = found.filter(F.col("folder") == only)
    folders = [(r["folder"], r["path"]) for r in found.orderBy("folder").collect()]
    if not folders:
        return None
    per = None
    if limit is not None:
        per = limit if only is not None else limit // len(folders)
    frames = [read_dataset(spark, p, f, schema, infer, per) for f, p in folders]
    return union_by_name(frames)


def load_audit(df: DataFrame) -> DataFrame:
    """Rows per dataset and the total (S16): ``rollup`` adds the total row
    with a null label."""
    return df.rollup(LABEL).agg(F.count(F.lit(1)).alias("rows"))


def write_audited(df: DataFrame, path: str, labels: list[str]) -> tuple[DataFrame, int]:
    """Write a load and audit it in the same pass (S16): (Label, rows) of the given labels,
    of all other rows together when there are any (``other``), and of the total under a null
    label, as ``load_audit`` gives them; and the number of bad cells. The counts are observed
    as the rows are written, none is read again.

    A session that has observed cannot be serialised, and a fitted binary forest holds its
    session: the rows are written, through a view, from another one of the same settings."""
    spark, seen, view = df.sparkSession, Observation("load"), f"load_{uuid.uuid4().hex}"
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    counts = [F.count_if(F.col(LABEL) == x).alias(f"rows_{k}") for k, x in enumerate(labels)]
    df.createGlobalTempView(view)
    try:
        own.table(f"{spark.conf.get('spark.sql.globalTempDatabase')}.{view}") \
            .observe(seen, F.count(F.lit(1)).alias("rows"), bad_cells(df), *counts) \
            .write.mode("overwrite").parquet(path)
        said = seen.get
    finally:
        spark.catalog.dropGlobalTempView(view)
    rows = [(x, said[f"rows_{k}"]) for k, x in enumerate(labels) if said[f"rows_{k}"]]
    other = said["rows"] - sum(n for _, n in rows)
    rows += [("other", other)] * (other > 0) + [(None, said["rows"])]
    return spark.createDataFrame(rows, f"{LABEL} string, rows long"), said["bad_cells"]

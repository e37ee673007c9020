"""Labelled CSV folders: discovery, unlike headers, quotas in file order."""

import os
import tempfile

from pyspark.sql import functions as F

from tidewatch.operators import prepare as P
from tidewatch.sources import labelled as L


def _write(root, name, header, rows, labels=True):
    d = os.path.join(root, name)
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, f"{name}_dataset.csv"), "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join(str(x) for x in r) + "\n")
    if labels:
        with open(os.path.join(d, f"{name}_labels.csv"), "w") as f:
            f.write("x\n1\n")


def test_load_union_clean_and_quota(spark):
    root = tempfile.mkdtemp(prefix="lab-")
    _write(root, "SYN_DoS", ["pkt_count", "mean_iat"], [(i, i / 10) for i in range(50)])
    _write(root, "OS_Scan", ["pkt_count", "avg_pkt_size", "kind"], [(i, 60.5, "a") for i in range(30)])
    _write(root, "Orphan", ["pkt_count"], [(1,)], labels=False)
    os.makedirs(os.path.join(root, ".hidden"))
    found = sorted(r.folder for r in L.discover(spark, root).collect())
    assert found == ["OS_Scan", "SYN_DoS"]
    rows = {r.folder: r.label_rows for r in L.dataset_audit(spark, root, require_labels=False).collect()}
    assert rows == {"OS_Scan": 1, "SYN_DoS": 1, "Orphan": None}
    df = L.load_labelled(spark, root)
    assert df.count() == 80
    audit = {r.Label: r.rows for r in L.load_audit(df).collect()}
    assert audit[None] == 80 and audit["SYN_DoS"] == 50
    assert P.bad_cell_count(df).first()[0] == 50 + 30 + 50  # missing columns are null
    for labels, want in ((["OS_Scan", "SYN_DoS", "None"], audit), (["OS_Scan"], {"OS_Scan": 30, "other": 50, None: 80})):
        seen, bad = L.write_audited(df, os.path.join(root, ".written"), labels)
        assert {r.Label: r.rows for r in seen.collect()} == want and bad == 130
        assert spark.read.parquet(os.path.join(root, ".written")).count() == 80
    clean = P.clean(df)
    assert clean.filter(F.col("mean_iat").isNull()).count() == 0
    first = L.load_labelled(spark, root, limit=40)  # 20 per folder, file order
    got = sorted(r.pkt_count for r in first.filter(F.col("Label") == "SYN_DoS").collect())
    assert got == list(range(20))
    one = L.load_labelled(spark, root, limit=7, only="OS_Scan")
    assert one.count() == 7


def test_first_rows_in_file_order_across_splits(spark):
    root = tempfile.mkdtemp(prefix="big-")
    _write(root, "X", ["v"], [(i,) for i in range(20000)])
    path = os.path.join(root, "X", "X_dataset.csv")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits
    try:
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
        assert df.rdd.getNumPartitions() > 5
        for n in (0, 1, 5000, 19_999, 20_000, 30_000):
            got = sorted(r.v for r in L.first_rows_in_file_order(df, n).collect())
            assert got == list(range(min(n, 20_000)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_prep_fit_transform_roundtrip(spark):
    df = spark.createDataFrame(
        [(1.0, "a", "X"), (2.0, "b", "Y"), (float("nan"), None, "X"), (4.0, "b", "Y")],
        "f double, s string, Label string")
    prep = P.Prep.fit(df)
    assert prep.features == ["f", "s_a", "s_b"]  # first category ('0') dropped
    out = prep.transform(df.withColumn("extra", F.lit(1)))
    rows = out.collect()
    assert len(rows[0].features) == 3 and {r.label_idx for r in rows} == {0, 1}
    again = P.Prep.from_json(prep.to_json())
    assert again.transform(df).collect() == prep.transform(df).collect()

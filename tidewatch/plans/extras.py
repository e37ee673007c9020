"""Registered queries for the remaining inventory rows: flow key text (F1),
alternate column names (P10), load audit (S16), semi/anti joins (J5, J6
forms), the runs table on the ``orders`` stand-in (O4, J7, C6, F8) and the
prepared feature rows (P15, P16, T4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalar import file_extension, flow_key_parts, flow_key_text
from ..operators import prepare as P
from ..operators import rules as R
from ..operators import runs as RU
from ..session import shared_path
from ..sources.labelled import load_audit
from . import sql_fixtures as sqlf
from .output import r6, round_doubles
from .preparation import datasets
from .tables import table
from .traffic import flows


def q_flow_keys(spark, sf_dir):
    f = flows(spark, sf_dir, "mixed")
    return f.select("capture_id", flow_key_text("src_ip", "dst_ip", "src_port", "dst_port", "proto")
                    .alias("flow_key"), "pkt_count")


def q_flow_key_parts(spark, sf_dir):
    """The key's text taken apart again (F1)."""
    keys = q_flow_keys(spark, sf_dir)
    return keys.select("capture_id", *flow_key_parts("flow_key").values(), "pkt_count")


def q_file_extensions(spark, sf_dir):
    """Extensions of names with, without and with several dots."""
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("Capture_"), F.col("o_orderkey").cast("string"),
                    F.when(F.col("o_orderkey") % 3 == 0, ".PCAP").when(F.col("o_orderkey") % 3 == 1, "")
                    .otherwise(".tar.Cap"))
    return o.select("o_orderkey", file_extension(name).alias("extension"))


def q_run_lifecycle(spark, sf_dir):
    """Runs queued, then finished from the orders' status, newest version per id."""
    rows = runs_from_orders(spark, sf_dir)
    queued = RU.queued(rows.select(F.col("file_path").alias("path"))).withColumn("version", F.lit(0))
    ended = rows.filter("status <> 'processing'").select(
        "file_path", F.when(F.col("status") == "completed", "{}").alias("result"), "error")
    done = RU.finish(queued.drop("version"), ended).withColumn("version", F.lit(1))
    newest = RU.newest(queued.unionByName(done))
    return newest.select("id", "filename", "status", "progress", "result", "error",
                         RU._outcome().alias("outcome"))


def q_renamed_signatures(spark, sf_dir):
    f = flows(spark, sf_dir, "mixed").drop("proto").withColumnRenamed("syn_count", "SYN_count")
    s = R.with_signatures(f)
    out = s.select("capture_id", "src_ip", "src_port", "dst_port", "proto",
                   F.col("sig.type").alias("sig_type"), F.col("sig.confidence").alias("sig_confidence"))
    return round_doubles(out)


def q_load_audit(spark, sf_dir):
    return load_audit(P.union_by_name(datasets(spark, sf_dir)))


def q_documents_labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


def q_documents_unlabelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'processing' END"


def runs_from_orders(spark, sf_dir):
    """Stand-in run rows: one per order (id, created_at, status)."""
    o = table(spark, sf_dir, "orders")
    status = F.expr(STATUS_SQL)
    name = F.concat(F.lit("capture_"), F.col("o_orderkey").cast("string"), F.lit(".pcap"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        name.alias("filename"),
        F.concat(F.lit("/captures/"), name).alias("file_path"),
        status.alias("status"),
        F.when(status == "processing", 50).otherwise(100).alias("progress"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
        F.lit(None).cast("string").alias("result"),
        F.when(status == "failed", "analysis error").alias("error"),
        F.lit(None).cast("string").alias("error_details"),
    )


def q_run_history(spark, sf_dir):
    h = RU.history(runs_from_orders(spark, sf_dir))
    return h.select("id", "filename", "status", RU.stamp("created_at").alias("created_at"))


def q_run_outcomes(spark, sf_dir):
    return RU.outcomes(runs_from_orders(spark, sf_dir))


def q_run_compaction(spark, sf_dir):
    """Runs queued, finished in two more versions with a compaction between and one after;
    read from what is left (O4, U5)."""
    rows, path = runs_from_orders(spark, sf_dir), shared_path(spark, "runs", uuid.uuid4().hex)
    RU.upsert(spark, path, RU.queued(rows.select(F.col("file_path").alias("path"))))
    for status in ("completed", "failed"):
        ended = rows.filter(F.col("status") == status).select(
            "file_path", F.when(F.col("status") == "completed", "{}").alias("result"), "error")
        RU.upsert(spark, path, RU.finish(RU.read(spark, path).join(ended.select("file_path"), "file_path",
                                                                   "left_semi"), ended))
        RU.compact(spark, path, grace_s=0)
    return RU.outcomes(RU.read(spark, path))


def q_prep_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus",
        F.col("l_returnflag").alias(P.LABEL))
    prep = P.Prep.fit(li)
    out = prep.transform(li)
    return out.groupBy(P.LABEL, "label_idx", F.size("features").alias("width")) \
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("features")[4] > 0).alias("open_rows"))


QUERIES = {
    "flow_keys": q_flow_keys,
    "flow_key_parts": q_flow_key_parts,
    "file_extensions": q_file_extensions,
    "run_lifecycle": q_run_lifecycle,
    "renamed_signatures": q_renamed_signatures,
    "load_audit": q_load_audit,
    "documents_labelled": q_documents_labelled,
    "documents_unlabelled": q_documents_unlabelled,
    "run_history": q_run_history,
    "run_outcomes": q_run_outcomes,
    "run_compaction": q_run_compaction,
    "prep_rows": q_prep_rows,
}

_UNION = " UNION ALL ".join(
    f"SELECT '{k}' AS Label FROM lineitem WHERE l_returnflag = '{k}'" for k in ("A", "N", "R"))

_RUNS = f"""SELECT CAST(o_orderkey AS VARCHAR) AS id,
                   'capture_' || CAST(o_orderkey AS VARCHAR) || '.pcap' AS filename,
                   {STATUS_SQL} AS status, o_orderdate FROM orders"""

ORACLE = {
    "flow_keys": f"""SELECT capture_id, concat_ws(':', src_ip, dst_ip, CAST(src_port AS VARCHAR),
                            CAST(dst_port AS VARCHAR), CAST(proto AS VARCHAR)) AS flow_key, pkt_count
                     FROM ({sqlf.flows_sql('mixed')})""",
    "renamed_signatures": f"""SELECT capture_id, src_ip, src_port, dst_port, proto, sig_type,
                                     {r6('sig_confidence')} AS sig_confidence
                              FROM ({sqlf.signatures_sql('mixed')})""",
    "load_audit": f"""SELECT Label, CAST(count(*) AS BIGINT) AS rows FROM ({_UNION}) GROUP BY ROLLUP (Label)""",
    "documents_labelled": """SELECT doc_id, source, lang FROM documents
                             WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "documents_unlabelled": """SELECT doc_id, source, lang FROM documents d
                               WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "run_history": f"""SELECT id, filename, status, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at
                       FROM ({_RUNS})""",
    "run_outcomes": f"""SELECT id, filename, status,
                               CAST(CASE WHEN status = 'processing' THEN 50 ELSE 100 END AS INTEGER) AS progress,
                               CASE WHEN status = 'failed' THEN 'analysis error' END AS error,
                               CASE WHEN status = 'completed' THEN 'ready' WHEN status = 'failed' THEN 'failed'
                                    ELSE 'pending' END AS outcome
                        FROM ({_RUNS})""",
    "run_compaction": f"""SELECT substr(sha256('/captures/' || filename), 1, 32) AS id, filename,
                                 CASE status WHEN 'processing' THEN 'queued' ELSE status END AS status,
                                 CAST(CASE WHEN status = 'processing' THEN 0 ELSE 100 END AS INTEGER) AS progress,
                                 CASE WHEN status = 'failed' THEN 'analysis error' END AS error,
                                 CASE WHEN status = 'completed' THEN 'ready' WHEN status = 'failed' THEN 'failed'
                                      ELSE 'pending' END AS outcome
                          FROM ({_RUNS})""",
    "prep_rows": """SELECT l_returnflag AS Label,
                           CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INTEGER) AS label_idx,
                           CAST(5 AS INTEGER) AS width,
                           CAST(count(*) AS BIGINT) AS rows,
                           CAST(count_if(l_linestatus = 'O') AS BIGINT) AS open_rows
                    FROM lineitem GROUP BY l_returnflag""",
    "flow_key_parts": f"""SELECT capture_id, src_ip, dst_ip, src_port, dst_port, proto, pkt_count
                          FROM ({sqlf.flows_sql('mixed')})""",
    "file_extensions": """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'pcap' WHEN 2 THEN 'cap' END AS extension
                          FROM orders""",
    "run_lifecycle": f"""SELECT substr(sha256('/captures/' || filename), 1, 32) AS id, filename,
                                CASE status WHEN 'processing' THEN 'queued' ELSE status END AS status,
                                CAST(CASE WHEN status = 'processing' THEN 0 ELSE 100 END AS INTEGER) AS progress,
                                CASE WHEN status = 'completed' THEN '{{}}' END AS result,
                                CASE WHEN status = 'failed' THEN 'analysis error' END AS error,
                                CASE WHEN status = 'completed' THEN 'ready' WHEN status = 'failed' THEN 'failed'
                                     ELSE 'pending' END AS outcome
                         FROM ({_RUNS})""",
}

"""Per-capture roll-up: label summary (A15, A16, O1), dominant attack (O2),
verdict text (C5), descriptions (J2, P17) and the empty case (S14).

Input is one row per flow with ``capture_id, first_pkt_no, label,
confidence``. The only shuffle is a partially aggregated ``groupBy(capture,
label)``; everything after runs on one row per (capture, label), so a capture
with a billion flows costs the same here as one with ten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import one_decimal
from ..schemas import ATTACK_DESCRIPTIONS

# Fixed verdict texts of the reference.
TXT_NO_FLOWS = "No valid network flows found in the pcap file"
TXT_NORMAL = "Traffic appears normal (≥95% normal flows)"
TXT_MOSTLY = "Traffic is mostly normal with some suspicious activities"
TXT_UNCLASSIFIED = "Traffic contains unusual patterns but could not be classified with confidence"


def descriptions(spark: SparkSession) -> DataFrame:
    """The 11-row label -> description table (fixed size, safe to broadcast)."""
    return spark.createDataFrame(ATTACK_DESCRIPTIONS, "label string, description string")


def label_summary(labelled: DataFrame) -> DataFrame:
    """One row per (capture, label): count, confidence mean/min/max, first seen
    flow, share of the capture's flows and rank (O1: share desc, then order
    of first appearance)."""
    per_label = labelled.groupBy("capture_id", "label").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("confidence").alias("confidence_sum"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.min("first_pkt_no").alias("first_seen"),
    )
    cap = Window.partitionBy("capture_id")
    total = F.sum("count").over(cap)
    rank_w = cap.orderBy(F.desc("count"), F.asc("first_seen"))
    return per_label.select(
        "capture_id", "label", "count",
        (F.col("confidence_sum") / F.col("count")).alias("avg_confidence"),
        "min_confidence", "max_confidence", "first_seen",
        total.alias("total_flows"),
        (F.col("count") / total * 100).alias("percentage"),
        F.row_number().over(rank_w).alias("rank"),
    )


def verdicts(labelled: DataFrame, captures: DataFrame | None = None,
             with_time: bool = True) -> DataFrame:
    """One verdict per capture (C5). ``captures`` (column ``capture_id``) adds
    an ``Unknown`` verdict for captures that produced no flow."""
    spark = labelled.sparkSession
    summary = label_summary(labelled).join(
        F.broadcast(descriptions(spark)), "label", "left")
    item = F.struct(
        F.col("label").alias("type"),
        F.coalesce("description", "label").alias("description"),
        F.col("count").alias("count"),
        F.col("percentage").alias("percentage"),
        F.col("avg_confidence").alias("confidence"),
    )
    is_attack = F.col("label") != "Normal"
    per_cap = summary.groupBy("capture_id").agg(
        F.max("total_flows").alias("flows_analyzed"),
        F.sum(F.when(F.col("label") == "Normal", F.col("count")).otherwise(0)).alias("normal_flows"),
        F.sort_array(F.collect_list(F.struct(F.col("rank").alias("r"), item.alias("v"))))
        .alias("_ranked"),
        F.max_by(F.when(is_attack, F.struct("label", "count", "avg_confidence", "percentage")),
                 F.when(is_attack, F.struct("count", (-F.col("first_seen")).alias("neg_first"))))
        .alias("dominant"),
    )
    normal_pct = F.col("normal_flows") / F.col("flows_analyzed") * 100
    dom = F.col("dominant")
    status = (
        F.when(normal_pct >= 95, "Normal Traffic")
        .when(normal_pct >= 80, "Mostly Normal Traffic")
        .when(dom.isNotNull() & (dom["avg_confidence"] >= 70),
              F.concat(F.lit("Attack Detected: "), dom["label"]))
        .otherwise("Uncertain Traffic Pattern")
    )
    details = (
        F.when(normal_pct >= 95, TXT_NORMAL)
        .when(normal_pct >= 80, TXT_MOSTLY)
        .when(dom.isNotNull() & (dom["avg_confidence"] >= 70),
              F.concat(one_decimal(dom["percentage"]), F.lit("% of flows classified as "),
                       dom["label"], F.lit(" attack (confidence: "),
                       one_decimal(dom["avg_confidence"]), F.lit("%)")))
        .when(dom.isNotNull(),
              F.concat(F.lit("Traffic shows patterns similar to "), dom["label"],
                       F.lit(" but with low confidence ("),
                       one_decimal(dom["avg_confidence"]), F.lit("%)")))
        .otherwise(TXT_UNCLASSIFIED)
    )
    out = per_cap.select(
        "capture_id",
        status.alias("status"),
        details.alias("details"),
        F.col("flows_analyzed").cast("long").alias("flows_analyzed"),
        normal_pct.alias("normal_percentage"),
        F.transform("_ranked", lambda x: x["v"]).alias("attack_types"),
    )
    if captures is not None:
        out = _with_empty_captures(captures, out)
    if with_time:
        out = out.withColumn("analysis_time",
                             F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    return out


def _with_empty_captures(captures: DataFrame, out: DataFrame) -> DataFrame:
    """Captures without flows get the ``Unknown`` verdict."""
    joined = captures.select("capture_id").distinct().join(out, "capture_id", "left")
    none = F.col("flows_analyzed").isNull()
    return joined.select(
        "capture_id",
        F.when(none, "Unknown").otherwise(F.col("status")).alias("status"),
        F.when(none, TXT_NO_FLOWS).otherwise(F.col("details")).alias("details"),
        F.coalesce("flows_analyzed", F.lit(0).cast("long")).alias("flows_analyzed"),
        F.when(none, F.lit(None).cast("double")).otherwise(F.col("normal_percentage"))
        .alias("normal_percentage"),
        F.when(none, F.array().cast(out.schema["attack_types"].dataType))
        .otherwise(F.col("attack_types")).alias("attack_types"),
    )


def flatten_attack_types(verdict: DataFrame) -> DataFrame:
    """One row per (capture, attack type) with its rank, for tabular output."""
    return verdict.select(
        "capture_id", F.posexplode("attack_types").alias("pos", "a")
    ).select("capture_id", (F.col("pos") + 1).alias("rank"), "a.*")


def batch_means(flows: DataFrame) -> DataFrame:
    """Means of three features over a batch of flows."""
    return flows.agg(
        F.avg("avg_pkt_size").alias("mean_avg_pkt_size"),
        F.avg("pkt_count").alias("mean_pkt_count"),
        F.avg("flow_duration").alias("mean_flow_duration"),
    )

"""Signature rules (C1), heuristic fallback (C2) and the merge with model
scores (C3, C4).

The reference runs its rules in order with the *last* match winning; a Spark
``when`` chain is first-match, so each chain below lists the rules in reverse.
The result is one nullable struct column ``sig{type, confidence}`` computed
row by row inside whole-stage codegen: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_div

# Columns the signature rules read; when any is missing the heuristic rules
# run instead (K8).
SIGNATURE_COLUMNS = ["proto", "syn_count", "pkt_count", "pkt_rate", "dst_port",
                     "src_port", "byte_rate", "syn_rate", "fin_rate", "rst_rate"]

# Alternate spellings renamed before the check (P10).
ALTERNATE_NAMES = {"protocol": "proto", "SYN_count": "syn_count"}

SIG_TYPE = "struct<type:string,confidence:double>"


def _chain(rules: list[tuple[Column, str, Column]]) -> Column:
    """rules in reference order -> struct of the last matching rule, else null."""
    out = None
    for cond, typ, conf in reversed(rules):
        val = F.struct(F.lit(typ).alias("type"), conf.cast("double").alias("confidence"))
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(F.lit(None).cast(SIG_TYPE))


def rename_alternates(df: DataFrame) -> DataFrame:
    """protocol -> proto, SYN_count -> syn_count, only where the target is absent."""
    cols = set(df.columns)
    mapping = {a: b for a, b in ALTERNATE_NAMES.items() if a in cols and b not in cols}
    return df.withColumnsRenamed(mapping) if mapping else df


def signature_expr() -> Column:
    """C1 as one expression over a flow row."""
    c = F.col
    ratio = safe_div("syn_count", "pkt_count")
    tcp = c("proto") == 6
    rules = [
        (tcp & (c("syn_count") > 0) & (ratio > 0.8) & (c("pkt_rate") > 100),
         "SYN_DoS", F.least(F.lit(95.0), 70 + ratio * 20)),
        ((c("proto") == 17) & (c("dst_port") == 1900) & (c("pkt_rate") > 50),
         "SSDP_Flood", F.least(F.lit(95.0), 70 + c("pkt_rate") / 10)),
        (tcp & (c("syn_count") > 10) & (c("syn_rate") > 0.7),
         "OS_Scan", F.least(F.lit(90.0), 70 + c("syn_count") / 5)),
        (tcp & ((c("dst_port") == 443) | (c("src_port") == 443))
         & (c("pkt_count") > 50) & (c("byte_rate") > 1000),
         "SSL_Renegotiation", F.lit(85.0)),
    ]
    attack = _chain(rules)
    normal = ((c("syn_rate") < 0.1) & (c("fin_rate") < 0.1) & (c("rst_rate") < 0.1)
              & (c("pkt_rate") < 50))
    normal_sig = F.struct(F.lit("Normal").alias("type"), F.lit(75.0).alias("confidence"))
    return F.when(attack.isNotNull(), attack).when(normal, normal_sig) \
        .otherwise(F.lit(None).cast(SIG_TYPE))


def heuristic_expr(columns) -> Column:
    """C2 over whatever columns exist; a rule whose column is absent is skipped."""
    have = set(columns)
    c = F.col
    rules: list[tuple[Column, str, Column]] = []
    if {"pkt_count", "flow_duration"} <= have:
        dur = c("flow_duration")
        pps = safe_div("pkt_count", "flow_duration")
        rules.append(((dur > 0) & (pps > 1000), "SYN_DoS", F.least(F.lit(90.0), 60 + pps / 100)))
        rules.append(((dur > 0) & (pps > 5000), "SSDP_Flood", F.least(F.lit(95.0), 60 + pps / 500)))
    if "avg_pkt_size" in have:
        rules.append((c("avg_pkt_size") < 60, "OS_Scan", F.lit(75.0)))
    if {"src_port", "dst_port"} <= have:
        if "pkt_count" in have:
            rules.append((c("dst_port").isin(80, 443) & (c("pkt_count") > 100),
                          "SYN_DoS", F.lit(80.0)))
        if "total_size" in have:
            rules.append(((c("dst_port") == 443) & (c("total_size") > 10000),
                          "SSL_Renegotiation", F.lit(75.0)))
        if "pkt_count" in have:
            rules.append(((c("src_port") < 1024) & (c("pkt_count") > 50),
                          "ARP_MitM", F.lit(70.0)))
    if "mean_iat" in have:
        rules.append((c("mean_iat") < 0.001, "SYN_DoS", F.lit(85.0)))

    checks = []
    if "pkt_count" in have:
        checks.append(c("pkt_count").between(5, 500))
    if "flow_duration" in have:
        checks.append(c("flow_duration").between(0.1, 60))
    if "avg_pkt_size" in have:
        checks.append(c("avg_pkt_size").between(80, 1500))
    if "mean_iat" in have:
        checks.append(c("mean_iat").between(0.01, 1))

    attack = _chain(rules) if rules else F.lit(None).cast(SIG_TYPE)
    if not checks:
        return attack
    score = sum((F.when(x, 1).otherwise(0) for x in checks[1:]),
                F.when(checks[0], 1).otherwise(0))
    normal_sig = F.struct(F.lit("Normal").alias("type"),
                          (70 + score * 5).cast("double").alias("confidence"))
    return F.when(attack.isNotNull(), attack) \
        .when(score / len(checks) > 0.6, normal_sig) \
        .otherwise(F.lit(None).cast(SIG_TYPE))


def uses_signatures(columns) -> bool:
    return set(SIGNATURE_COLUMNS) <= set(columns)


def with_signatures(flows: DataFrame, out: str = "sig") -> DataFrame:
    """Add ``sig`` (C1, or C2 when any signature column is missing; P14)."""
    df = rename_alternates(flows)
    expr = signature_expr() if uses_signatures(df.columns) else heuristic_expr(df.columns)
    return df.withColumn(out, expr)


def merge_with_model(scored: DataFrame, merge: str = "max",
                     override_at: float = 90.0) -> DataFrame:
    """Combine model output with the signature of the same row.

    ``scored`` has ``sig``, ``pred_label`` and ``pred_prob`` (0..1). The
    confidence is the larger of model and signature (``merge='max'``, the
    reference's rule, K6) or only lifted by a signature of the same type
    (``merge='same_type'``). A signature at ``override_at`` or above replaces
    label and confidence.
    """
    model_conf = F.col("pred_prob") * 100
    sig_conf = F.coalesce(F.col("sig.confidence"), F.lit(0.0))
    if merge == "max":
        lifted = F.when(sig_conf > 0, F.greatest(model_conf, sig_conf)).otherwise(model_conf)
    elif merge == "same_type":
        lifted = F.when((sig_conf > 0) & (F.col("sig.type") == F.col("pred_label")),
                        F.greatest(model_conf, sig_conf)).otherwise(model_conf)
    else:
        raise ValueError("merge must be 'max' or 'same_type'")
    override = sig_conf >= override_at
    return scored.withColumns({
        "label": F.when(override, F.col("sig.type")).otherwise(F.col("pred_label")),
        "confidence": F.when(override, sig_conf).otherwise(lifted),
    })


def rules_only(flows_with_sig: DataFrame, unmatched_label: str = "Unknown") -> DataFrame:
    """Label flows by signature alone (no model): a flow without a signature
    gets ``unmatched_label`` with confidence 0."""
    return flows_with_sig.withColumns({
        "label": F.coalesce(F.col("sig.type"), F.lit(unmatched_label)),
        "confidence": F.coalesce(F.col("sig.confidence"), F.lit(0.0)),
    })


def signature_hits(flows_with_sig: DataFrame, by_capture: bool = True) -> DataFrame:
    """Signature hits per type."""
    keys = ["capture_id"] if by_capture else []
    return (flows_with_sig.filter(F.col("sig").isNotNull())
            .groupBy(*keys, F.col("sig.type").alias("sig_type"))
            .agg(F.count(F.lit(1)).alias("hits")))

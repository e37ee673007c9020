"""Packets -> one-way flows with 23 features.

Skew: a flood can put a third of all packets in one flow, so no step may hold
a whole flow in one task. Packets are grouped by (flow key, pkt_no bucket),
where a bucket spans ``bucket_span`` consecutive packet numbers of a capture,
so each window task sees at most ``bucket_span`` packets of one flow. The
gaps across bucket edges are stitched on the small per-bucket table, and the
gap statistics are merged exactly:

* count, sum, sum of squares (exact decimal), min and max merge directly;
* the mean is the telescoping sum (last - first) / (n - 1), in integers;
* the population variance is (n * S2 - S1^2) / n^2 in exact integers, so the
  result does not depend on partitioning; if those integers overflow
  (decimal(38)), it falls back to the stable parallel merge in doubles,
  M2 = sum(M2_i + n_i * (mean_i - mean)^2).

Shuffles: one of the packet rows on (flow key, bucket); everything after runs
on one row per flow bucket. Time stays in integer microseconds until the last
projection (K3), and "first"/"last" follow capture order, not time (K2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import flag_set, safe_div
from ..schemas import FEATURES, FLOW_KEY, FLOWS

# 2**20 packets per flow bucket bounds one window group to ~1M rows.
DEFAULT_BUCKET_SPAN = 1 << 20

US = 1_000_000.0

# TCP flag masks in the order the features are emitted.
FLAG_MASKS = [("syn", 0x02), ("fin", 0x01), ("rst", 0x04), ("psh", 0x08),
              ("ack", 0x10), ("urg", 0x20)]


def _square(c):
    """Exact square of a long as decimal(38,0); (2**63)**2 < 10**38, so it
    cannot overflow."""
    d = F.col(c).cast("decimal(19,0)")
    return d * d


def flow_parts(packets: DataFrame, bucket_span: int = DEFAULT_BUCKET_SPAN,
               idle_us: int | None = None) -> DataFrame:
    """One row per (flow, bucket): counts, sums, ends and inner-gap moments. With
    ``idle_us`` a longer gap ends a part, and none of its moments hold that gap."""
    # a capture without packets is one row of nulls: no flow
    p = packets.filter(F.col("pkt_no").isNotNull()).withColumn("bucket", F.expr(f"div(pkt_no, {int(bucket_span)})"))
    w = Window.partitionBy(*FLOW_KEY, "bucket").orderBy("pkt_no")
    p = p.withColumn("gap", F.col("ts_us") - F.lag("ts_us").over(w))
    keys = [*FLOW_KEY, "bucket"]
    if idle_us is not None:
        broken = F.col("gap") > idle_us
        p = p.withColumn("run", F.sum(F.when(broken, 1).otherwise(0)).over(w)) \
            .withColumn("gap", F.when(~broken, F.col("gap")))
        keys.append("run")
    tcp = F.col("proto") == 6
    flag_aggs = [
        F.count_if(tcp & flag_set("tcp_flags", m)).alias(f"{n}_count")
        for n, m in FLAG_MASKS
    ]
    return p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("pkt_no").alias("first_pkt_no"),
        F.min_by("ts_us", "pkt_no").alias("first_ts"),
        F.max_by("ts_us", "pkt_no").alias("last_ts"),
        F.sum("ip_len").alias("total_size"),
        F.count("gap").alias("g_n"),
        F.sum("gap").alias("g_sum"),
        F.try_sum(_square("gap")).alias("g_s2"),
        F.avg("gap").alias("g_mean"),
        (F.var_pop("gap") * F.count("gap")).alias("g_m2"),
        F.min("gap").alias("g_min"),
        F.max("gap").alias("g_max"),
        *flag_aggs,
    )


def flow_features(packets: DataFrame, bucket_span: int = DEFAULT_BUCKET_SPAN) -> DataFrame:
    """Flow table (schema ``FLOWS``): one row per directional flow key."""
    return _finish(_merged(flow_parts(packets, bucket_span), FLOW_KEY))


def flow_sessions(packets: DataFrame, idle_us: int,
                  bucket_span: int = DEFAULT_BUCKET_SPAN) -> DataFrame:
    """Flow table with a row per flow key and session: a flow ends after a gap of more
    than ``idle_us`` and what follows is a new one (schema ``FLOWS``)."""
    return finished(merged_sessions(flow_parts(packets, bucket_span, idle_us), idle_us))


def merged_sessions(parts: DataFrame, idle_us: int) -> DataFrame:
    """Parts of flows (``flow_parts`` of the same ``idle_us``, or what this gave before)
    merged: a part for each session, exact in every moment. Parts of a flow must not overlap
    in packet numbers."""
    w = Window.partitionBy(*FLOW_KEY).orderBy("first_pkt_no")
    begins = F.col("first_ts") - F.lag("last_ts").over(w) > idle_us
    b = parts.withColumn("session", F.sum(F.when(begins, 1).otherwise(0)).over(w)) \
        .withColumn("bucket", F.col("first_pkt_no"))
    m = _merged(b, [*FLOW_KEY, "session"])
    mean = F.when(F.col("gap_n") > 0, (F.col("last_ts") - F.col("first_ts")) / F.col("gap_n"))
    return m.select(*FLOW_KEY, F.col("pkt_count").alias("n"), "first_pkt_no", "first_ts", "last_ts",
                    "total_size", F.col("gap_n").alias("g_n"), F.col("gap_s1").alias("g_sum"),
                    F.col("gap_s2").alias("g_s2"), mean.alias("g_mean"),
                    F.col("gap_m2").alias("g_m2"), F.col("gap_min").alias("g_min"),
                    F.col("gap_max").alias("g_max"), *[f"{n}_count" for n, _ in FLAG_MASKS])


def finished(parts: DataFrame) -> DataFrame:
    """The flow table of merged parts, one row each."""
    return _finish(parts.select(
        *FLOW_KEY, F.col("n").alias("pkt_count"), "first_pkt_no", "first_ts", "last_ts", "total_size",
        F.col("g_n").alias("gap_n"), F.col("g_sum").alias("gap_s1"), F.col("g_s2").alias("gap_s2"),
        F.col("g_m2").alias("gap_m2"), F.col("g_min").alias("gap_min"), F.col("g_max").alias("gap_max"),
        *[f"{n}_count" for n, _ in FLAG_MASKS]))


def _merged(b: DataFrame, keys: list[str]) -> DataFrame:
    """Parts merged by ``keys`` in the order of ``bucket``, the gaps between them counted."""
    by_flow = Window.partitionBy(*keys)
    ordered = by_flow.orderBy("bucket")
    # Gap from the last packet of the previous bucket to the first of this one.
    b = b.withColumn("edge", F.col("first_ts") - F.lag("last_ts").over(ordered))
    gaps_n = F.col("g_n") + F.when(F.col("edge").isNotNull(), 1).otherwise(0)
    gaps_sum = F.coalesce(F.col("g_sum"), F.lit(0)) + F.coalesce(F.col("edge"), F.lit(0))
    b = b.withColumn(
        "flow_gap_mean",
        safe_div(F.sum(gaps_sum).over(by_flow), F.sum(gaps_n).over(by_flow)),
    )
    m = F.col("flow_gap_mean")
    dev = (
        F.coalesce(F.col("g_m2") + F.col("g_n") * F.pow(F.col("g_mean") - m, 2), F.lit(0.0))
        + F.coalesce(F.pow(F.col("edge") - m, 2), F.lit(0.0))
    )
    b = b.withColumn("dev", dev)
    inner_s2 = F.when(F.col("g_n") == 0, F.lit(0).cast("decimal(38,0)")).otherwise(F.col("g_s2"))
    s2 = inner_s2 + F.coalesce(_square("edge"), F.lit(0).cast("decimal(38,0)"))

    return b.groupBy(*keys).agg(
        F.sum("n").alias("pkt_count"),
        F.min("first_pkt_no").alias("first_pkt_no"),
        F.min_by("first_ts", "bucket").alias("first_ts"),
        F.max_by("last_ts", "bucket").alias("last_ts"),
        F.sum("total_size").alias("total_size"),
        F.sum(gaps_n).alias("gap_n"),
        F.least(F.min("g_min"), F.min("edge")).alias("gap_min"),
        F.greatest(F.max("g_max"), F.max("edge")).alias("gap_max"),
        F.sum("dev").alias("gap_m2"),
        F.try_sum(F.coalesce(F.col("g_sum"), F.lit(0)) + F.coalesce(F.col("edge"), F.lit(0)))
        .alias("gap_s1"),
        # a bucket that overflowed leaves no exact sum: null, not the sum of the rest
        F.when(F.count_if(s2.isNull()) == 0, F.try_sum(s2)).alias("gap_s2"),
        *[F.sum(f"{n}_count").alias(f"{n}_count") for n, _ in FLAG_MASKS],
    )


def _finish(agg: DataFrame) -> DataFrame:
    has_gaps = F.col("gap_n") > 0
    dur_us = F.col("last_ts") - F.col("first_ts")
    duration = dur_us / F.lit(US)
    exprs = {
        "protocol": F.col("proto"),
        "proto": F.col("proto"),
        "pkt_count": F.col("pkt_count"),
        "flow_duration": duration,
        "total_size": F.col("total_size"),
        "avg_pkt_size": safe_div("total_size", "pkt_count"),
        "mean_iat": F.when(has_gaps, dur_us / F.col("gap_n") / F.lit(US)).otherwise(0.0),
        "std_iat": F.when(has_gaps, _std_us() / F.lit(US)).otherwise(0.0),
        "min_iat": F.when(has_gaps, F.col("gap_min") / F.lit(US)).otherwise(0.0),
        "max_iat": F.when(has_gaps, F.col("gap_max") / F.lit(US)).otherwise(0.0),
        "src_port": F.col("src_port"),
        "dst_port": F.col("dst_port"),
        "pkt_rate": F.when(duration > 0, F.col("pkt_count") / duration).otherwise(0.0),
        "byte_rate": F.when(duration > 0, F.col("total_size") / duration).otherwise(0.0),
        "syn_rate": safe_div("syn_count", "pkt_count"),
        "fin_rate": safe_div("fin_count", "pkt_count"),
        "rst_rate": safe_div("rst_count", "pkt_count"),
    }
    for n, _ in FLAG_MASKS:
        exprs[f"{n}_count"] = F.col(f"{n}_count")
    cols = [F.col(c) for c in ("capture_id", "src_ip", "dst_ip", "first_pkt_no")]
    cols += [exprs[f].cast(FLOWS[f].dataType).alias(f) for f in FEATURES]
    return agg.select(*cols)


def _std_us():
    """Population std of the gaps in microseconds: exact integers when they
    fit, the merged double moments otherwise."""
    n = F.col("gap_n")
    m2n = F.try_subtract(
        F.try_multiply(n.cast("decimal(19,0)"), F.col("gap_s2")),
        F.try_multiply(F.col("gap_s1").cast("decimal(19,0)"), F.col("gap_s1").cast("decimal(19,0)")),
    )
    nd = n.cast("double")
    exact = F.sqrt(m2n.cast("double") / (nd * nd))
    return F.coalesce(exact, F.sqrt(F.col("gap_m2") / n))

"""Score captures end to end (T14): packets -> flows -> signatures -> model
scores (optional) -> merged labels -> one verdict per capture.

Shuffles: packet rows once on (flow key, bucket); then per-flow rows stay
where they are through rules and scoring (narrow), and the roll-up shuffles
one partial aggregate row per (task, capture, label).
"""

from __future__ import annotations

import os
import traceback
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ATTACK_TYPE
from ..session import shared_path
from ..sources import capture as cap
from ..sources import capture_ranges
from . import flows as flows_op
from . import model as model_op
from . import rules as rules_op
from . import verdict as verdict_op

FLOW_ID = ["capture_id", "src_ip", "dst_ip", "first_pkt_no"]


def label_flows(flows: DataFrame, bundle=None, merge: str = "max") -> DataFrame:
    """Per-flow ``label`` and ``confidence``: rules only without a model,
    else model scores merged with signatures (C3, C4)."""
    with_sig = rules_op.with_signatures(flows)
    if bundle is None:
        return rules_op.rules_only(with_sig)
    scored = model_op.score(bundle, with_sig, keep=[*FLOW_ID, "sig"])
    return rules_op.merge_with_model(scored, merge=merge)


def analyze(packets: DataFrame, bundle=None, captures: DataFrame | None = None,
            merge: str = "max", bucket_span: int = flows_op.DEFAULT_BUCKET_SPAN,
            with_time: bool = True) -> DataFrame:
    """Verdict per capture (schema ``VERDICT`` + ``analysis_time``).

    Captures are those of ``captures``, or those named in ``packets``: a decoded
    capture without packets is there as a row of nulls, so it ends as ``Unknown``.
    ``packets`` is read twice; decode captures into a table first
    (``capture.decode_once``)."""
    flows = flows_op.flow_features(packets, bucket_span)
    labelled = label_flows(flows, bundle, merge)
    if captures is None:
        captures = packets.select("capture_id").distinct()
    return verdict_op.verdicts(labelled, captures, with_time=with_time)


ERROR_STATUS = "Error during analysis"
ERROR_DETAILS = "An error occurred during analysis: "


def analyze_isolated(packets: DataFrame, bundle=None, captures: DataFrame | None = None,
                     merge: str = "max", bucket_span: int = flows_op.DEFAULT_BUCKET_SPAN) -> DataFrame:
    """Verdicts as ``analyze`` gives them, with ``error`` and ``error_details``, even where
    scoring raises (C6).

    All captures are analysed at once. If that raises, the captures are halved by their id
    and each half is tried again, until a capture that raises stands alone: it ends in the
    minimal result, with its error and the number of its flows, and all others in their
    verdict. So one bad capture among n costs about 2 log n further jobs, and none where
    nothing raises. ``packets`` should be a written table. Verdicts are written under the
    shared folder, and read back from there."""
    spark = packets.sparkSession
    if captures is None:
        captures = packets.select("capture_id").distinct()
    captures = captures.select("capture_id").distinct()
    base = shared_path(spark, "analysis", uuid.uuid4().hex)
    made = []

    def attempt(low, high):
        """The captures from id ``low`` (None: the first) up to below ``high``."""
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col("capture_id") >= low)
        if high is not None:
            inside = inside & (F.col("capture_id") < high)
        path = os.path.join(base, str(len(made)))
        mine = packets.filter(inside)
        try:
            out = analyze(mine, bundle, captures.filter(inside), merge, bucket_span) \
                .withColumns({c: F.lit(None).cast("string") for c in ("error", "error_details")})
            out.write.parquet(path)
            made.append(spark.read.schema(out.schema).parquet(path))
            return
        except Exception as e:     # whatever a capture's data or the model brings about
            some, trace = captures.filter(inside).orderBy("capture_id"), traceback.format_exc()
            n = some.count()
            if n > 1:
                middle = some.offset(n // 2).first()["capture_id"]
            elif n == 1:
                made.append(_minimal(some, mine, bucket_span, e, trace))
        if n > 1:
            attempt(low, middle)
            attempt(middle, high)

    attempt(None, None)
    out = made[0] if made else analyze(packets.limit(0), None, captures).withColumns(
        {c: F.lit(None).cast("string") for c in ("error", "error_details")})
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def _minimal(capture: DataFrame, packets: DataFrame, bucket_span: int, error: Exception,
             trace: str) -> DataFrame:
    """The result of a capture whose analysis raised."""
    lines = [x.strip() for x in str(error).splitlines() if x.strip()]
    text = (lines or [type(error).__name__])[0][:2000]
    try:
        flows = flows_op.flow_features(packets, bucket_span).count()
    except Exception:              # its flows themselves cannot be made
        flows = 0
    return capture.select(
        "capture_id", F.lit(ERROR_STATUS).alias("status"), F.lit(ERROR_DETAILS + text).alias("details"),
        F.lit(flows).cast("long").alias("flows_analyzed"),
        F.lit(None).cast("double").alias("normal_percentage"),
        F.array().cast(f"array<{ATTACK_TYPE.simpleString()}>").alias("attack_types"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("analysis_time"),
        F.lit(text).alias("error"), F.lit(trace[-20_000:]).alias("error_details"))


def analyze_captures(spark, path: str, work: str, bundle=None, merge: str = "max",
                     max_bytes: int = cap.MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(verdicts, faults) of the captures under ``path``: they are decoded once, large
    ones by many tasks, into ``<work>/packets``."""
    good, bad = cap.split_errors(capture_ranges.decode_split(spark, path, f"{work}/packets", max_bytes))
    return analyze(good, bundle, merge=merge), bad


def verdict_json(verdicts: DataFrame) -> DataFrame:
    """(capture_id, result JSON text) for storage in the runs table."""
    body = F.struct(*[c for c in verdicts.columns if c != "capture_id"])
    return verdicts.select("capture_id", F.to_json(body).alias("result"))

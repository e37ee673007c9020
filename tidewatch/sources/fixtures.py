"""Packet stand-in derived from the ``events`` table.

Integer arithmetic only, so Spark and DuckDB give the same packets. Each
``user_id % 8`` class produces traffic with a distinct signature outcome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PACKETS

EPOCH_2024_US = 1704067200000000

# Fixed values of the stand-in, by class c = user_id % 8:
# time divisor D, destination port.
TIME_DIVISOR = {0: 50_000, 1: 50_000_000, 2: 500_000, 3: 5_000_000,
                4: 500_000, 5: 20_000_000, 6: 50_000, 7: 500_000}
DST_PORT = {0: 80, 1: 80, 2: 22, 3: 1900, 4: 443, 5: 1900, 6: 53, 7: 8080}

CAPTURE_MODES = ("single", "by_class", "mixed")


def _by_class(c, mapping):
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr


def capture_expr(mode: str):
    if mode == "single":
        return F.lit("cap0")
    if mode == "by_class":
        return (F.col("user_id") % 8).cast("string")
    if mode == "mixed":
        return F.concat(F.lit("cap"), (F.expr("div(user_id, 8)") % 4).cast("string"))
    raise ValueError(f"capture mode must be one of {CAPTURE_MODES}")


def packets_from_events(events: DataFrame, captures: str = "single") -> DataFrame:
    """One packet per event, with the ``packets`` schema."""
    c = F.col("user_id") % 8
    # Microseconds since 2024-01-01 of the wall-clock value: independent of
    # the session time zone (ts is timestamp_ntz).
    off = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    flags = (
        F.when(c.isin(0, 4), 24)
        .when(c == 1, 2)
        .when(c == 2, F.when(F.col("event_type") == "purchase", 20).otherwise(2))
        .when(c == 7, F.when(F.col("event_type") == "error", 17).otherwise(24))
        .otherwise(0)
    )
    out = events.select(
        capture_expr(captures).alias("capture_id"),
        F.col("event_id").alias("pkt_no"),
        off.alias("_off"),
        c.alias("_c"),
        F.concat(F.lit("10.0."), F.expr("div(user_id, 256)").cast("string"),
                 F.lit("."), (F.col("user_id") % 256).cast("string")).alias("src_ip"),
        F.lit("192.168.0.1").alias("dst_ip"),
        F.when(c.isin(3, 5, 6), 17).otherwise(6).cast("int").alias("proto"),
        F.when(c == 1, F.lit(1024) + F.col("event_id") % 16)
        .otherwise(F.lit(40000) + F.col("user_id") % 1000).cast("int").alias("src_port"),
        _by_class(c, DST_PORT).cast("int").alias("dst_port"),
        (F.lit(60) + (F.col("event_id") * 37) % 1400).cast("long").alias("ip_len"),
        flags.cast("int").alias("tcp_flags"),
    )
    ts_us = F.expr("div(_off, " + _divisor_sql() + ")")
    return out.withColumn("ts_us", ts_us).select(*PACKETS.fieldNames())


def _divisor_sql() -> str:
    cases = " ".join(f"WHEN _c = {k} THEN {v}" for k, v in TIME_DIVISOR.items())
    return f"CASE {cases} END"

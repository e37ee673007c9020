"""Column-expression helpers (all JVM-side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den, default=0.0) -> Column:
    """num / den when den > 0, else ``default`` (F3). ANSI mode raises on a
    zero divisor, so the guard is part of the expression, not an afterthought."""
    n, d = col(num), col(den)
    return F.when(d > 0, n / d).otherwise(F.lit(default))


def flag_set(flags, mask: int) -> Column:
    """True where ``flags & mask`` is non-zero (F2)."""
    return col(flags).bitwiseAND(F.lit(mask)) != 0


def finite_or_zero(c) -> Column:
    """null, NaN, +inf and -inf all become 0 (P2); other values pass."""
    x = col(c)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def argmax_index(arr) -> Column:
    """0-based index of the largest element; the first wins ties."""
    a = col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def one_decimal(x) -> Column:
    """Fixed one-decimal text, rounding the exact binary value half-even, as
    Python's ``'%.1f'`` does (F7)."""
    return F.format_number(col(x), 1)


def file_extension(name) -> Column:
    """Lower-cased text after the last dot, null when there is no dot."""
    n = col(name)
    return F.when(F.instr(n, ".") > 0,
                  F.lower(F.element_at(F.split(n, r"\."), -1)))


def flow_key_text(*cols) -> Column:
    """``src:dst:sport:dport:proto`` text for output (F1)."""
    return F.concat_ws(":", *[col(c).cast("string") for c in cols])


def flow_key_parts(key) -> dict[str, Column]:
    """The five fields of a flow key text (F1); each null when it has not five."""
    parts = F.split(col(key), ":")
    five = F.size(parts) == 5
    out = {}
    for i, (name, kind) in enumerate((("src_ip", "string"), ("dst_ip", "string"), ("src_port", "int"),
                                      ("dst_port", "int"), ("proto", "int"))):
        out[name] = F.when(five, F.get(parts, F.lit(i)).try_cast(kind)).alias(name)
    return out

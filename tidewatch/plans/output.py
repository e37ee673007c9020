"""Output shaping shared by the registered queries.

Doubles are rounded to six places with one explicit formula,
``floor(x * 1e6 + 0.5) / 1e6``, written the same way on the Spark and the
DuckDB side: the engines' own ``round`` functions disagree on exact halves,
and integer-microsecond inputs produce exact halves often. Beyond 1e12 a
double has no sixth decimal, so such values pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 1_000_000.0
LIMIT = 1e12


def round6(c):
    x = F.col(c) if isinstance(c, str) else c
    x = x.cast("double")
    return F.when(F.abs(x) < LIMIT, F.floor(x * SCALE + 0.5) / SCALE).otherwise(x)


def round_doubles(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round6(f.name).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def r6(expr: str) -> str:
    """SQL text of ``round6`` for the DuckDB side."""
    e = f"CAST(({expr}) AS DOUBLE)"
    return f"(CASE WHEN abs({e}) < {LIMIT:.0f} THEN floor({e} * 1000000.0 + 0.5) / 1000000.0 ELSE {e} END)"

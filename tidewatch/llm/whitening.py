"""Embedding whitening by polarisation covariance (operator 11).

The covariance of two dimensions follows from three variances:
``cov(a, b) = (var(a + b) - var(a) - var(b)) / 2``. So all that is gathered from the
corpus is one kind of sum, of squares: of the centred values of every dimension and of
every sum of two dimensions. Entries are integers x (``floor(1024 * c) + 100000``),
centred exactly, as ``n * x - S`` with S the dimension's sum; the squares are added up
exactly, in 64-bit halves inside a task and in 32-bit limbs between tasks. Only the
differences of variances that are left at the end are rounded.

On Spark: the integer vectors are written once; then three narrow passes over them.
(1) n and S; (2) a row of limbs per pair and task, added up by pair; (3) whitened
vectors, written, whose own covariance is then taken by Spark's built-in (centred,
mergeable) ``covar_pop``. Vectors are never shuffled; the driver holds dimensions x
dimensions numbers, which is what ``eigh`` works on.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import int_matrix, table, written

SCALE, SHIFT = 1024, 100_000
TOP = 8                      # components returned
LIMIT = 2.0 ** 62            # 1024 * c is cut off here, to fit a long
TILE = 4096                  # rows whose squares are added up together
LIMBS, LIMB = 8, 32          # a sum of squares between tasks: 8 limbs of 32 bits


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, z): ``z = x - SHIFT`` of the rows that take part."""
    fine = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c)
                    & (F.abs(c.cast("double")) < float("inf")))
    return vectors.filter(F.col(vec_col).isNotNull()).filter(fine).select(
        F.col(id_col).alias("vec_id"),
        F.transform(vec_col, lambda c: F.floor(F.least(F.greatest(
            c.cast("double") * SCALE, F.lit(-LIMIT)), F.lit(LIMIT))).cast("long")).alias("z"))


# ------------------------------------------------------------------- sums

def _dimension_sums(batches):
    """n and the sum of z by dimension, exactly, for one task."""
    n, total = 0, np.zeros(0, dtype=object)
    for batch in batches:
        z = int_matrix(batch.column("z"))
        n += len(z)
        if z.shape[1] > len(total):
            total = np.concatenate((total, np.zeros(z.shape[1] - len(total), dtype=object)))
        top = int(np.abs(z).max(initial=0))
        kind = np.int64 if top * max(1, len(z)) < 1 << 62 else object
        total[:z.shape[1]] += z.astype(kind).sum(axis=0).astype(object)
    # dimension -1 carries n, so that rows of no components are counted too
    yield pa.RecordBatch.from_arrays(
        [pa.array([-1, *range(len(total))], pa.int32()),
         pa.array([Decimal(n), *(Decimal(int(s)) for s in total)], pa.decimal128(38, 0))],
        names=["dim", "s"])


def dimension_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(n, S): the number of vectors and x's sum in each dimension. A vector that ends
    early has zero entries there, so x is ``SHIFT``."""
    got = {r["dim"]: int(r["s"]) for r in rows.select("z").mapInArrow(
        _dimension_sums, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()}
    n = got.pop(-1, 0)
    return n, [got[d] + n * SHIFT for d in sorted(got)]


def centred(z: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` exactly: longs where they fit, else Python integers."""
    offset = [n * SHIFT - s for s in sums]
    top = n * int(np.abs(z).max(initial=0)) + max(map(abs, offset), default=0)
    if top < 1 << 62:
        return z * np.int64(n) + np.array(offset, dtype=np.int64)
    return z.astype(object) * n + np.array(offset, dtype=object)


def add_squares(total: list[np.ndarray], y: np.ndarray) -> None:
    """Adds the squares of centred rows ``y`` to ``total``: of dimension i at
    ``total[i][0]``, of the sum of dimensions i and i + k at ``total[i][k]``."""
    for at in range(0, len(y), TILE):
        part = np.ascontiguousarray(y[at:at + TILE].T)
        bits = (2 * int(abs(part).max(initial=0))).bit_length()
        half = (bits + 1) // 2
        for i, mine in enumerate(total):
            w = part[i] + part[i:]
            w[0] = part[i]
            if part.dtype == object or bits > 50:
                mine += (w.astype(object) ** 2).sum(axis=1)
            elif 2 * bits + 12 <= 62:
                mine += np.einsum("jr,jr->j", w, w).astype(object)
            else:        # w = high * 2**half + low, each half of 25 bits at most
                high, low = w >> half, w & ((1 << half) - 1)
                mine += ((np.einsum("jr,jr->j", high, high).astype(object) << (2 * half))
                         + (np.einsum("jr,jr->j", high, low).astype(object) << (half + 1))
                         + np.einsum("jr,jr->j", low, low))


def _square_sums(n: int, sums: list[int]):
    width = len(sums)

    def run(batches):
        total = [np.zeros(width - i, dtype=object) for i in range(width)]
        for batch in batches:
            add_squares(total, centred(int_matrix(batch.column("z"), width), n, sums))
        for i, mine in enumerate(total):
            limbs = [pa.array([int(s) >> (LIMB * k) & ((1 << LIMB) - 1) for s in mine], pa.int64())
                     for k in range(LIMBS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(mine), pa.int32()), pa.array(range(i, width), pa.int32()), *limbs],
                names=["i", "j", *(f"l{k}" for k in range(LIMBS))])
    return run


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """x's covariance matrix, divisor n, each entry rounded once."""
    names = [f"l{k}" for k in range(LIMBS)]
    got = rows.select("z").mapInArrow(
        _square_sums(n, sums), ", ".join(["i int", "j int", *(f"{c} long" for c in names)])) \
        .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    limbs = [got.column(c).to_pylist() for c in names]
    squares = {(i, j): sum(v << (LIMB * k) for k, v in enumerate(values))
               for i, j, *values in zip(got.column("i").to_pylist(), got.column("j").to_pylist(), *limbs)}
    out = np.zeros((len(sums), len(sums)))
    for (i, j), q in squares.items():
        # squares are of n times the centred values, and there are n of them
        if i == j:
            out[i, i] = q / n ** 3
        else:
            out[i, j] = out[j, i] = (q - squares[i, i] - squares[j, j]) / (2 * n ** 3)
    return out


# ---------------------------------------------------------------- whitening

def components(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, each with its largest
    coordinate positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    lead = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[lead, range(len(lead))] < 0, -1.0, 1.0)


def _deviations(y: np.ndarray) -> list[int]:
    """Sum of a row's squares, exactly."""
    top = int(abs(y).max(initial=0))
    if y.dtype != object and top * top * max(1, y.shape[1]) < 1 << 62:
        return (y ** 2).sum(axis=1).tolist()
    return [int(s) for s in (y.astype(object) ** 2).sum(axis=1)]


def _whitened(n: int, sums: list[int], basis: np.ndarray):
    def run(batches):
        for batch in batches:
            y = centred(int_matrix(batch.column("z"), len(sums)), n, sums)
            w = (y.astype(np.float64) / n) @ basis
            exact = _deviations(y)
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"),
                 pa.array([d if d < 1 << 63 else None for d in exact], pa.int64()),
                 pa.array([Decimal(d) if d < 10 ** 38 else None for d in exact], pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(w).ravel()))],
                names=["vec_id", "deviation", "deviation_exact", "w"])
    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           top: int = TOP) -> DataFrame:
    """A row per vector that takes part and component up to ``top`` (from 1, by falling
    eigenvalue): vec_id, component, n, deviation, whitened, explained, identity_error,
    deviation_exact.

    A vector that is null or holds null or non-finite entries is dropped; shorter ones
    end in zeros, and 1024 times an entry is cut off at +-2**62. Rows with a null id and
    repeated rows are fitted and returned as often as they come. ``deviation`` is null
    where it exceeds a long (``deviation_exact``: 38 digits). ``whitened`` and
    ``identity_error`` leave out components without variance (fewer different vectors
    than components): ``whitened`` is null there, ``explained`` 0, or null where nothing
    varies. An empty table, or one of empty vectors, gives no rows. Other columns are not
    read; only the id is taken over, so names do not clash."""
    rows = written(integers(vectors, id_col, vec_col), "integers")
    n, sums = dimension_sums(rows)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if n and sums:
        values, basis = components(covariance(rows, n, sums))
    else:
        values, basis = np.zeros(0), np.zeros((len(sums), 0))
    top = min(top, len(values))
    trace, e = float(values.sum()), values[:top]
    vary = e > max(values.max(initial=0.0), 0.0) * len(values) * np.finfo(float).eps
    scaled = basis[:, :top] / np.sqrt(np.where(vary, e, 1.0))
    made = written(rows.mapInArrow(
        _whitened(n, sums, scaled),
        f"vec_id {kind}, deviation long, deviation_exact decimal(38,0), w array<double>"), "whitened")
    use = [int(k) for k in np.flatnonzero(vary)]
    error = None
    if use:
        def entry(k):
            return F.get("w", F.lit(k))
        pairs = [(k, m) for k in use for m in use if k <= m]
        got = made.agg(*[F.covar_pop(entry(k), entry(m)).alias(f"c{k}_{m}") for k, m in pairs]).first()
        error = max(abs(got[f"c{k}_{m}"] - (k == m)) for k, m in pairs)
    shares = [float(v / trace) if trace > 0 else None for v in np.maximum(e, 0.0)]

    def per_component(numbers, k):
        return F.get(F.array(*[F.lit(v).cast("double") for v in numbers]) if numbers
                     else F.array().cast("array<double>"), k)
    flags = F.array(*[F.lit(bool(v)) for v in vary]) if top else F.array().cast("array<boolean>")
    at = F.col("at")
    return made.select("*", F.posexplode("w").alias("at", "raw")).select(
        "vec_id", (at + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.get(flags, at), F.col("raw")).alias("whitened"),
        per_component(shares, at).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"), "deviation_exact")


def query(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_embedding_whitening": query}

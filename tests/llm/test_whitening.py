"""Polarisation covariance against exact fractions; whitened vectors against the contract."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidewatch.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n int, component string, z int, w int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 2, 3) for i, v in rows], SCHEMA)


def exact(rows):
    fine = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in fine), default=0)
    top = int(whitening.LIMIT)
    x = [[max(-top, min(top, math.floor(Fraction(c) * 1024))) + 100_000 for c in [*v, *[0.0] * (width - len(v))]]
         for _, v in fine]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = [[n * a - s for a, s in zip(row, sums)] for row in x]
    cov = [[float(Fraction(sum(r[a] * r[b] for r in y), n ** 3)) for b in range(width)] for a in range(width)]
    return fine, y, np.array(cov), n


def check(spark, rows, top=whitening.TOP):
    fine, y, cov, n = exact(rows)
    ints = whitening.integers(frame(spark, rows), "vec_id", "embedding")
    count, sums = whitening.dimension_sums(ints)
    assert count == n
    got = whitening.covariance(ints, count, sums)
    assert np.array_equal(got, cov)                     # rounded once on either side
    out = whitening.whiten(frame(spark, rows), top=top).collect()
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    assert len(out) == len(fine) * min(top, len(values))
    centre = np.array([[float(Fraction(v, n)) for v in r] for r in y])
    w = np.zeros((len(fine), top))
    seen = {}
    for r in out:
        seen.setdefault((r["vec_id"], r["deviation_exact"]), {})[r["component"]] = r
    for k, ((i, _), row) in enumerate(zip(fine, y)):
        dev = sum(v * v for v in row)
        mine = seen[(i, dev)]
        assert sorted(mine) == list(range(1, min(top, len(values)) + 1))
        for c, r in mine.items():
            assert r["n"] == n and r["deviation"] == (dev if dev < 1 << 63 else None)
            assert math.isclose(r["explained"], values[c - 1] / np.trace(cov), rel_tol=1e-6, abs_tol=1e-9)
            assert r["identity_error"] < 1e-4
            w[k, c - 1] = r["whitened"]
            assert abs(abs(r["whitened"]) - abs(centre[k] @ basis[:, c - 1]) / math.sqrt(values[c - 1])) < 1e-6
    assert np.abs(w.T @ w / n - np.eye(top))[:len(values), :len(values)].max() < 1e-6


@pytest.mark.parametrize("scale", [0.2, 5000.0])
def test_against_exact_fractions(spark, scale):
    rng = np.random.default_rng(1)
    mix = rng.normal(0, scale, (12, 12))
    check(spark, [(k, v.tolist()) for k, v in enumerate(rng.normal(0, 1, (300, 12)) @ mix + 3)])


def test_few_dimensions_short_vectors_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(0, 1, (50, 3)))]
    rows += [(100, [1.5, 2.0]), (101, []), (102, None), (103, [1.0, None, 2.0]), (104, [float("nan")] * 3),
             (105, [float("inf"), 0.0, 1.0]), rows[4]]
    check(spark, rows, top=2)


def test_huge_entries_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(k, v) for k, v in enumerate((rng.normal(0, 1, (40, 3)) * [1e15, 1e13, 1e12]).tolist())]
    _, y, cov, n = exact(rows)
    ints = whitening.integers(frame(spark, rows), "vec_id", "embedding")
    assert np.array_equal(whitening.covariance(ints, *whitening.dimension_sums(ints)), cov)
    got = whitening.whiten(frame(spark, rows + [(99, [1e300, 0.0, -1e300])])).collect()
    assert len(got) == 41 * 3
    assert all(r["identity_error"] < 1e-4 for r in got)


def test_squares_in_halves_match_python():
    rng = np.random.default_rng(5)
    for bits in (10, 24, 25, 40, 49, 55):
        y = rng.integers(-(1 << bits), 1 << bits, (50, 3))
        total = [np.zeros(3 - i, dtype=object) for i in range(3)]
        whitening.add_squares(total, y)
        for i in range(3):
            for k in range(3 - i):
                assert total[i][k] == sum((int(r[i]) + (int(r[i + k]) if k else 0)) ** 2 for r in y)


def test_without_variance(spark):
    out = whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(out) == 6
    assert {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in out} == {(None, None, None, 0)}
    line = whitening.whiten(frame(spark, [(k, [float(k), 0.0]) for k in range(5)])).collect()
    assert [r["whitened"] is None for r in sorted(line, key=lambda r: (r["component"], r["vec_id"]))] == [False] * 5 + [True] * 5


def test_empty_tables(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [])])).collect() == []

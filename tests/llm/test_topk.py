"""Exact top-k search against brute force, ties and awkward vectors."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, k=topk.K, every=topk.EVERY):
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in fine:
        if q % every:
            continue
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, **more).collect())


@pytest.mark.parametrize("query_block", [topk.QUERY_BLOCK, 3])
def test_against_brute_force(spark, query_block):
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(0, 0.2, 16) * (rng.random(16) < 0.5)])
            for k in range(300)]
    assert run(spark, rows, query_block=query_block) == slow(rows)


def test_ties_go_to_the_smaller_id(spark):
    rng = random.Random(0)
    ids = list(range(200))
    rng.shuffle(ids)
    rows = [(k, [rng.choice([0.0, 0.5]), 0.5]) for k in ids]
    assert run(spark, rows) == slow(rows)


def test_few_rows_and_awkward_vectors(spark):
    rows = [(0, [1.0, -1.0]), (20, [0.5]), (3, [1.0, 2.0, 3.0]), (4, None), (5, [None, 1.0]),
            (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (-20, []),
            (40, [0.0, 0.0]), (8, [-0.001, 70000.0])]
    got = run(spark, rows)
    assert got == slow(rows)
    assert {g[0] for g in got} == {0, 20, -20, 40}


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, [(20, [1.0])]) == []


def test_repeated_rows(spark):
    rows = [(20, [1.0]), (20, [1.0]), (1, [2.0]), (1, [2.0])]
    assert run(spark, rows) == sorted([(20, 1, 1, 8192), (20, 2, 1, 8192)] * 2)


def test_extra_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], SCHEMA) \
        .selectExpr("*", "1 AS v", "2 AS score", "3 AS query_id", "4 AS rank")
    assert [tuple(r) for r in topk.top_k(df).collect()] == [(0, 1, 1, 4096)]


def test_scores_scatter_like_a_product():
    rng = np.random.default_rng(1)
    for density in (0.05, 0.6, 1.0):
        q = rng.integers(-9, 9, (7, 12)) * (rng.random((7, 12)) < density)
        r = rng.integers(-9, 9, (30, 12)) * (rng.random((30, 12)) < density)
        assert (topk.scores(q, r) == q @ r.T).all()
    big = np.full((1, 2), 1 << 25)
    assert topk.scores(big, big).tolist() == [[1 << 51]]
    with pytest.raises(OverflowError):
        topk.scores(np.full((1, 1), 1 << 40), np.full((1, 1), 1 << 40))


def test_matrix_pads_short_rows():
    column = pa.array([[1, 2], [], [3]], pa.list_(pa.int64()))
    assert topk._matrix(column).tolist() == [[1, 2], [0, 0], [3, 0]]
    assert topk._matrix(column[1:]).tolist() == [[0], [3]]

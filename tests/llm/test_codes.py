"""Vector codes against a plain Lloyd loop; residents and movers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidewatch.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code int, entry string, position long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def slow(rows, parts, entries, rounds):
    fine = [(i, [max(-codes.LIMIT, min(codes.LIMIT, math.floor(256 * x))) for x in v], label)
            for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not fine:
        return [], []
    width = max(1, -(-max(len(v) for _, v, _ in fine) // parts))
    cut = [[(v + [0] * parts * width)[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in fine]
    first = sorted(range(len(fine)), key=lambda k: (fine[k][0] is None, fine[k][0] or 0, fine[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for c in cut:
                members.setdefault(near(c[p], book)[1], []).append(c[p])
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e])] if e in members else c
                        for e, c in enumerate(book)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    label_error = {}
    for (_, _, label), e in zip(fine, error):
        label_error[label] = label_error.get(label, 0) + e
    return sorted((i if i is not None else -99, "".join(f"{e:02x}" for _, e in f), err, label_error[label], digest)
                  for (i, _, label), f, err in zip(fine, found, error)), books


def run(spark, rows, **more):
    got, books = codes.compress(frame(spark, rows), **more)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((r[0] if r[0] is not None else -99, *r[1:]) for r in got.collect()), books


@pytest.mark.parametrize("rounds", [0, 1, 2, 4])
def test_against_a_plain_loop(spark, rounds):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 24)],
             rng.choice([1, 2, None])) for i in rng.permutation(300)]
    got, books = run(spark, rows, parts=8, entries=12, rounds=rounds)
    want, slow_books = slow(rows, 8, 12, rounds)
    assert books.tolist() == slow_books
    assert got == want


def test_a_third_of_all_rows_alike(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice([-0.5, 0.25, 0.5]) for _ in range(32)], 1) for k in range(200)]
    rows += [(1000 + k, rows[7][1], 2) for k in range(100)] + [rows[3]] * 30
    assert run(spark, rows)[0] == slow(rows, codes.PARTS, codes.ENTRIES, codes.ROUNDS)[0]


def test_awkward_vectors(spark):
    rows = [(5, [1.0, -1.0], 1), (3, [0.1], None), (4, None, 1), (6, [None, 1.0], 1), (7, [float("nan")], 1),
            (8, [float("-inf")], 2), (None, [0.5] * 40, None), (5, [1.0, -1.0], 1), (9, [], 2),
            (10, [3e38, -3e38, 70000.0], 2)]
    assert run(spark, rows)[0] == slow(rows, codes.PARTS, codes.ENTRIES, codes.ROUNDS)[0]
    assert run(spark, [(None, [0.5], 1)])[0] == slow([(None, [0.5], 1)], 16, 64, 2)[0]


def test_empty_tables(spark):
    assert run(spark, [])[0] == []
    assert run(spark, [(1, None, 1)])[0] == []


def test_nearest_is_exact_beyond_doubles():
    big = codes.LIMIT
    entries = np.array([[big, -big], [big - 1, -big], [-big, big]], dtype=np.int64)
    parts = np.array([[big, -big], [big - 1, -big], [0, 0]], dtype=np.int64)
    which, apart = codes.nearest(parts, entries)
    assert which.tolist() == [0, 1, 1] and apart.tolist()[:2] == [0, 0]


def test_only_parts_that_change_entry_move(spark):
    rng = np.random.default_rng(4)
    books = rng.integers(-50, 50, (2, 4, 2))
    later = books + rng.integers(-9, 9, books.shape)
    members = [(int(p), int(codes.nearest(v[None], books[p])[0][0]), 0, v.tolist())
               for p in range(2) for v in rng.integers(-60, 60, (200, 2))]
    home = spark.createDataFrame(members, codes.MEMBER)
    moved = home.mapInArrow(codes._leavers(2, [], later), codes.MEMBER).collect()
    want = [(p, int(codes.nearest(np.array([v]), later[p])[0][0]), s, v) for p, e, s, v in members]
    assert sorted((r[0], r[1], r[2], list(r[3])) for r in moved) == sorted(
        w for w, m in zip(want, members) if w[1] != m[1])
    assert 0 < len(moved) < len(members)

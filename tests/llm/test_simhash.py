"""SimHash near-duplicates against brute force and on awkward rows."""

import random

import numpy as np
import pytest
import xxhash
from llm_fixtures import SF_SMALL, documents, make_docs, texts  # noqa: F401

from tidewatch.llm import simhash


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids_and_fps):
    group = list(range(len(ids_and_fps)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k
    for i, (_, a) in enumerate(ids_and_fps):
        for j in range(i):
            if (a ^ ids_and_fps[j][1]).bit_count() <= 3:
                group[top(i)] = top(j)
    least = {}
    for k, (d, _) in enumerate(ids_and_fps):
        if d is not None:
            least[top(k)] = min(d, least.get(top(k), d))
    return [least.get(top(k)) for k in range(len(group))]


@pytest.mark.parametrize("text", [
    None, "", " \t\n", "One", "one two", "one two three", "A b c D\x0be f\x1cg É ß",
    "word " * 5000, "x" * 100_000])
def test_fingerprint_by_hand(text):
    assert simhash.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


def test_query_matches_brute_force(spark, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"])
           for r in simhash.query(spark, SF_SMALL).collect()}
    rows = [(d, slow_fingerprint(t)) for d, t in sorted(texts.items())]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(rows, slow_components(rows))}
    assert got == want


def _near(rng, base, bits):
    for b in rng.sample(range(64), bits):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 8])
def test_components_of_planted_fingerprints(spark, chunk):
    """Chains and clouds of fingerprints; a small chunk splits crowded buckets."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for base in fps[:6]:
        for _ in range(25):
            fps.append(_near(rng, rng.choice([base, fps[-1]]), rng.randint(1, 4)))
    rows = [(k, f) for k, f in enumerate(fps)]
    signed = [(k, int(np.uint64(f).astype(np.int64))) for k, f in rows]
    df = spark.createDataFrame(signed, "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.grouped(df, chunk=chunk).collect()}
    assert [got[k] for k, _ in rows] == slow_components(rows)


def test_links_find_every_distance_up_to_three(spark):
    rng = random.Random(1)
    pairs = []
    for bits in (1, 2, 3, 4, 5):
        for _ in range(40):
            a = rng.getrandbits(64)
            pairs.append((a, _near(rng, a, bits), bits))
    flat = [int(np.uint64(f).astype(np.int64)) for p in pairs for f in p[:2]]
    got = {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in simhash.links(
        spark.createDataFrame([(f,) for f in flat], "fp long")).collect()}
    assert got == {frozenset(p[:2]) for p in pairs if p[2] <= 3}


def test_rejects_more_bits(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), max_bits=4)


def test_null_empty_and_repeated_rows(make_docs):
    docs = make_docs([(1, None), (2, ""), (None, " "), (4, "a b c d"), (4, "a b c d"), (7, "z")]) \
        .selectExpr("*", "'x' AS fp", "1 AS component_id", "2 AS root")
    got = sorted(((r["doc_id"], r["component_id"]) for r in
                  simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 1), (4, 4), (4, 4), (7, 7)], key=str)


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).collect() == []


def test_one_of_each_group_stays(make_docs):
    docs = make_docs([(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"),
                      (9, "q r s t u"), (None, "w x y z"), (11, None), (12, "")]) \
        .selectExpr("*", "1 AS fp", "2 AS n")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(3, "a b c d"), (9, "q r s t u"), (None, "w x y z"), (11, None)], key=str)

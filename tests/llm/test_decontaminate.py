"""Benchmark decontamination: nothing lost against exact containment."""

import random
import re

import pytest
from llm_fixtures import documents, make_docs  # noqa: F401

from tidewatch.llm import decontaminate


def shingles(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    if not words:
        return set()
    return {" ".join(words[i:i + 5]) for i in range(max(len(words) - 4, 1))}


def slow(docs, items):
    out = set()
    for d, t in docs:
        for i, q in items:
            n = len(shingles(q))
            shared = len(shingles(q) & shingles(t))
            if n and 10 * shared >= 8 * n:
                out.add((d, i, n, shared))
    return out


def found(docs, items):
    return {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"])
            for r in decontaminate.contaminated(docs, items).collect()}


def make_items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("seed", range(3))
def test_partial_containment_like_brute_force(spark, make_docs, seed):
    """Items of 1 to 90 words, copied whole or in parts into longer texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, prose(rng.choice([1, 3, 4, 5, 6, 9, 14, 30, 60, 90]))) for k in range(40)]
    docs = []
    for d in range(120):
        words = prose(rng.randint(0, 120))
        _, item = rng.choice(items)
        part = item[:max(1, round(len(item) * rng.choice([0.5, 0.75, 0.82, 0.9, 1])))]
        if rng.random() < 0.3 and len(part) > 8:        # a word in the middle changed
            part = part[:4] + ["other"] + part[5:]
        at = rng.randint(0, len(words))
        docs.append((d, " ".join(words[:at] + part + words[at:])))
    items = [(k, " ".join(w)) for k, w in items]
    want = slow(docs, items)
    assert len(want) > 20
    assert found(make_docs(docs), make_items(spark, items)) == want


def test_case_and_punctuation_do_not_matter(spark, make_docs):
    items = make_items(spark, [(1, "The quick, brown fox jumps over the lazy dog")])
    docs = make_docs([(1, "x THE QUICK\nbrown--fox Jumps over the lazy dog y"), (2, "the quick fox")])
    assert [(d, i) for d, i, *_ in found(docs, items)] == [(1, 1)]


def test_awkward_rows(spark, make_docs):
    text = "alpha beta gamma delta epsilon zeta eta"
    items = make_items(spark, [(1, text), (1, text), (2, None), (3, ""), (None, "one two"), (4, "!?")])
    docs = make_docs([(1, text), (1, text), (1, "other words"), (None, text), (5, None), (6, ""),
                      (7, "one two"), (8, "one two three"), (9, (text + " ") * 3000)]) \
        .selectExpr("*", "1 AS item_id", "2 AS h", "3 AS s", "'x' AS t", "4 AS text_hash")
    got = sorted(((r["doc_id"], r["item_id"]) for r in
                  decontaminate.contaminated(docs, items).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (7, None), (9, 1)], key=str)
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(
        [(1, "other words"), (5, None), (6, ""), (8, "one two three")], key=str)


def test_empty_tables(spark, make_docs):
    items = make_items(spark, [(1, "a b c d e f")])
    assert found(make_docs([]), items) == set()
    assert found(make_docs([(1, "a b c d e f")]), make_items(spark, [])) == set()


def test_only_data_frame_operations(spark, documents, capsys):
    df = decontaminate.contaminated(documents, documents.selectExpr("doc_id AS item_id", "text"))
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sketch_is_as_long_as_its_partition_needs(spark):
    items = make_items(spark, [(n, " ".join(f"x{n}y{k}" for k in range(n + 4)))
                               for n in (1, 4, 5, 7, 8, 31, 40)])
    rows = decontaminate.item_shingles(items, "item_id", "text").collect()
    for n in (1, 4, 5, 7, 8, 31, 40):
        own = sorted((r["h"], r["in_sketch"]) for r in rows if r["item_id"] == n)
        assert len(own) == n
        k = sum(s for _, s in own)
        assert [s for _, s in own] == [True] * k + [False] * (n - k)     # the smallest
        assert k >= n - -(-8 * n // 10) + 1                             # one more than may miss

"""Context mixing: baseline by hand, a true probability, learning, awkward rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import SF_SMALL
from llm_fixtures import make_docs, documents, texts  # noqa: F401

from tidewatch.llm import mixing
from tidewatch.llm.common import written

END = object()


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def slow_base(rows):
    counts = Counter(w for d, t in rows if d is not None and not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return n, [(d, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)),
                sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for d, t in rows]


@pytest.mark.parametrize("head", [mixing.HEAD, 50])
def test_query_baseline_by_hand(spark, texts, monkeypatch, head):
    """A small head sends most tokens through the join."""
    monkeypatch.setattr(mixing, "HEAD", head)
    n, want = slow_base(sorted(texts.items()))
    got = sorted(mixing.query(spark, SF_SMALL).collect())
    assert len(got) == len(want)
    for r, (d, n_tokens, n_known, base) in zip(got, want):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (d, n_tokens, n_known, n)
        assert r["held_out"] == held(d)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0
        size = max(1, len((texts[d] or "").encode()))
        assert math.isclose(r["bits_per_byte"], -r["score"] / math.log10(2) / size, rel_tol=1e-9)


@pytest.fixture(scope="module")
def trained(spark, documents):
    learn = documents.filter("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 7) <> 2").select("text")
    pairs = np.zeros((256, 257), dtype=np.int64)
    for r in learn.collect():
        data = [10, *mixing.lowered(r["text"]), 256]
        np.add.at(pairs, (data[:-1], data[1:]), 1)
    alphabet = mixing.Alphabet(pairs)
    return alphabet, mixing.context_odds(learn, alphabet)


def bits(texts, trained, **more):
    return mixing.mixed_bits([mixing.lowered(t) for t in texts], *trained, **more)


def test_learns_from_the_corpus(texts, trained):
    some = [t for d, t in sorted(texts.items()) if held(d)]
    size = sum(len(t.encode()) for t in some)
    assert bits(some, trained).sum() / size < 3.2
    shuffled = ["".join(np.random.default_rng(0).permutation(list(t))) for t in some]
    assert bits(shuffled, trained).sum() > 1.4 * bits(some, trained).sum()


def test_weights_are_refined_while_reading(texts, trained):
    some = [t for d, t in sorted(texts.items()) if held(d) and len(t) > 2000]
    assert bits(some, trained).sum() < bits(some, trained, rate=0.0).sum()


def test_next_symbols_are_a_distribution(trained):
    """The probabilities of all symbols after a text add up to one."""
    alphabet, _ = trained
    before = "the and "
    stem = bits([before], trained)[0]
    seen = [bytes([b]) for b in range(256) if alphabet.of_byte[b] != mixing.ESCAPE]
    total = 0.0
    # P(text + x ends) / P(x ends | ...) telescopes over the shared prefix: compare
    # the cost of the symbol after the prefix alone
    for x in [None, *seen]:
        data = mixing.lowered(before) + (x or b"")
        total += 2.0 ** -_symbol_bits(data, len(before), trained)
    unseen = 256 - len(seen)
    if unseen:
        raw = next(bytes([b]) for b in range(256) if alphabet.of_byte[b] == mixing.ESCAPE)
        total += 256 * 2.0 ** -_symbol_bits(mixing.lowered(before) + raw, len(before), trained)
    assert math.isclose(total, 1.0, rel_tol=1e-3)
    assert stem > 0


def _symbol_bits(data, at, trained):
    """The cost of the symbol at ``at`` (end: past the last byte), from prefixes'
    costs: all within the first stretch, so the weights are the first ones."""
    alphabet, odds = trained
    whole, starts, sizes = mixing._laid_out([data])
    symbols, before = mixing._symbols(whole, starts, sizes, alphabet)
    spot = starts[0] + at
    rows = [r[spot] for r in mixing._rows(whole, before, alphabet)]
    cost = 8.0 if symbols[spot] == mixing.ESCAPE else 0.0
    for node, bit in alphabet.paths[before[spot]][symbols[spot]]:
        total = sum(w / mixing.ODDS * odds[r + node] for w, r in zip(mixing.WEIGHTS, rows))
        p = 1 / (1 + math.exp(-total))
        cost -= math.log2(p if bit else 1 - p)
    return cost


def test_first_stretch_adds_up_its_symbols(trained):
    data = mixing.lowered("The and of it, therhean\x01 is.")
    want = sum(_symbol_bits(data, k, trained) for k in range(len(data) + 1))
    assert math.isclose(bits([data.decode()], trained)[0], want, rel_tol=1e-4)


def test_score_does_not_depend_on_company(texts, trained):
    some = [t for _, t in sorted(texts.items())][:30] + ["", "a", "z" * 5000]
    together = bits(some, trained)
    alone = [bits([t], trained)[0] for t in some]
    assert np.allclose(together, alone, rtol=1e-4)


def test_codes_are_full_trees_and_rows_belong_to_one():
    pairs = np.zeros((256, 257), dtype=np.int64)
    for p, b, n in ((97, 32, 10), (98, 97, 1), (32, 97, 1 << 40), (97, 256, 5)):
        pairs[p, b] = n
    for table in (pairs, np.zeros_like(pairs)):
        alphabet = mixing.Alphabet(table)
        for tree in alphabet.paths:
            assert math.isclose(sum(2.0 ** -len(p) for p in tree), 1.0)
            assert len({tuple(b for _, b in p) for p in tree}) == alphabet.size
            assert max(map(len, tree)) < 20
        at = 0
        for bits, first, rows in zip(mixing.SLOT_BITS, alphabet.first, alphabet.rows):
            assert first[0] == at and rows.min() >= 1 and rows.sum() <= 1 << bits
            assert (np.diff(first) == rows[:-1]).all()
            at += 1 << bits


def test_pairs_are_counted():
    batch = pa.RecordBatch.from_pydict({"t": ["Ab b", None, "", "a\n"]})
    out = list(mixing._count_tokens([batch]))
    got = dict(zip(out[-1]["byte"].to_pylist(), out[-1]["n"].to_pylist()))
    want = Counter()
    for t in ("ab b", "", "", "a\n"):
        data = [10, *t.encode(), 256]
        want.update(257 * x + y for x, y in zip(data, data[1:]))
    assert got == want
    words = {w: n for b in out for w, n in zip(b["token"].to_pylist(), b["n"].to_pylist()) if w}
    assert words == {b"ab": 1, b"b": 1, b"a": 1}


def test_blocks_pack_and_merge(spark):
    rng = np.random.default_rng(0)
    counts = (rng.random(2000) ** 40 * 1e9).astype(np.int64)
    assert (mixing._unpacked(mixing._packed(counts)) == counts).all()
    rows = [(b, task, mixing._packed(counts)) for b in range(3) for task in range(70)]
    blocks = spark.createDataFrame(rows, "block int, part int, counts binary")
    got = mixing._merged(blocks, 70, lambda c, _: mixing._packed(c)).collect()
    assert sorted(r["block"] for r in got) == [0, 1, 2]
    assert all((mixing._unpacked(r["odds"]) == 70 * counts).all() for r in got)


def test_awkward_rows(make_docs):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "one two"), (4, "One two one " * 30_000),
            (5, "One two"), (5, "One two"), (6, "\x00\x01 é"), (14, "zz"), (15, "unseen Ж")]
    docs = make_docs(rows).selectExpr("*", "1 AS row", "2 AS token", "3 AS h", "4 AS score")
    n, want = slow_base(rows)
    got = mixing.score(docs).collect()
    key = lambda r: (str(r[0]), round(r[3], 6))
    assert sorted([(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got],
                  key=key) == sorted([(*w[:3], round(w[3], 6)) for w in want], key=key)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert next(r["held_out"] for r in got if r["doc_id"] is None)


def test_nothing_to_learn_from(make_docs):
    assert mixing.score(make_docs([])).collect() == []
    ids = [k for k in range(100) if held(k)][:3]
    got = mixing.score(make_docs([(k, "a b") for k in ids])).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] \
        == [(3, 0, 0, 0.0)] * 3
    assert all(np.isfinite(r["score"]) for r in got)


def test_refined_all_through_the_text(trained):
    """Short fixed stretches up to the end of a long text, not longer ones later on."""
    spans = list(mixing._stretches(20_001))
    assert spans[0][0] == 0 and spans[-1][1] >= 20_001
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert max(b - a for a, b in spans) <= 64
    # what comes after place 8192 is learned from at once
    head, tail = "the cat and the dog. " * 400, "qzqz xjxj " * 100
    late = bits([head + tail], trained)[0] - bits([head], trained)[0]
    still = bits([head + tail], trained, rate=0.0)[0] - bits([head], trained, rate=0.0)[0]
    assert late < 0.95 * still


def test_three_bytes_are_a_context(trained):
    """Where only the fourth byte before differs, two tables agree; where the third, one."""
    alphabet, _ = trained

    def rows(text):
        data, starts, sizes = mixing._laid_out([text])
        before = mixing._symbols(data, starts, sizes, alphabet)[1]
        return [int(r[starts[0] + 4]) for r in mixing._rows(data, before, alphabet)]

    def agree(a, b):
        return sum(x == y for x, y in zip(rows(a), rows(b)))

    assert agree(b"stone", b"atone") == 2
    assert agree(b"stone", b"saone") == 1


def test_ids_keep_their_scores_over_shuffled_inputs(spark, documents):
    """However the input's plan deals its rows, and whatever adaptive planning makes of
    it, a document's figures are its own."""
    figures = ["held_out", "n_tokens", "n_known", "base_score", "score"]
    docs = documents.limit(60)
    docs = written(docs, "some")
    want = {r["doc_id"]: [r[c] for c in figures] for r in mixing.score(docs).collect()}
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    try:
        for advised in (before, "2k"):
            spark.conf.set(size, advised)
            for shuffled in (docs.dropDuplicates(["doc_id"]), docs.repartition(5, "source"),
                             docs.groupBy("doc_id").agg({"text": "min"}).withColumnRenamed("min(text)", "text"),
                             docs.coalesce(1).orderBy("text")):
                got = {r["doc_id"]: [r[c] for c in figures] for r in mixing.score(shuffled).collect()}
                assert set(got) == set(want)
                for d, values in got.items():
                    assert values[:3] == want[d][:3]
                    assert values[3:] == pytest.approx(want[d][3:], rel=1e-9)
    finally:
        spark.conf.set(size, before)

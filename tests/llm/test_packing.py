"""Best-fit packing: exact ids, gapless sequences, few of them, awkward rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_fixtures import SF_SMALL, documents, make_docs, texts  # noqa: F401
from tokenizers import Tokenizer

from tidewatch.llm import packing


@pytest.fixture(scope="module")
def encode():
    tok = Tokenizer.from_file(packing.tokenizer_paths()[0])
    return lambda text: [*tok.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, ids_of, length):
    """Pieces cover the documents; sequences are gapless and not too long."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids_of)
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        ids, at = ids_of[d], 0
        assert len(pieces) == max(1, -(-len(ids) // length))
        for k, r in enumerate(pieces):
            data = np.array(ids[at:at + r["length"]], dtype="<u4")
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(data.tobytes()))
            assert k == 0 or r["length"] == length
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return len(by_seq)


def test_query_packs_every_document(spark, texts, encode):
    rows = packing.query(spark, SF_SMALL).collect()
    ids = {d: encode(t) for d, t in texts.items()}
    made = check(rows, ids, 2048)
    assert made <= -(-sum(map(len, ids.values())) // 2048) + 1


def slow_best_fit(lengths, room):
    bins, out = [], []
    for n in lengths:
        fits = [(left, k) for k, left in enumerate(bins) if left >= n]
        if fits:
            tight = min(left for left, _ in fits)
            k = next(k for left, k in fits if left == tight)
        else:
            bins.append(room)
            k = len(bins) - 1
        bins[k] -= n
        out.append(bins[k])
    return len(bins), sorted(bins), out


@pytest.mark.parametrize("seed", range(5))
def test_tree_finds_the_tightest_bin(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    made = packing.best_fit(lengths, 100)
    room = defaultdict(lambda: 100)
    lefts = []
    for n, (b, offset) in zip(lengths, made):
        assert offset == 100 - room[b]
        room[b] -= n
        lefts.append(room[b])
    n_bins, bins, want = slow_best_fit(lengths, 100)
    assert (len(room), sorted(room.values()), lefts) == (n_bins, bins, want)


def test_rejects_a_piece_that_fits_nowhere():
    with pytest.raises(ValueError):
        packing.best_fit([5], 4)


@pytest.mark.parametrize("text", [
    "plain words", "a<|endoftext|>b", "naïve façade — ünïcödé 你好 🙂", "\x00\t\r\n  tabs   ",
    "don't we'll I'M 12345678 $%^&*()", "x" * 30_000, " " * 5000, "ab " * 4000])
def test_ranks_give_the_tokenizers_ids(text, encode):
    assert [*packing.encoder(packing.tokenizer_paths())(text), 0] == encode(text)


def test_all_test_documents_have_the_tokenizers_ids(texts, encode):
    fast = packing.encoder(packing.tokenizer_paths())
    assert all([*fast(t), 0] == encode(t) for t in texts.values())


def test_awkward_rows(make_docs, encode):
    docs = make_docs([(1, None), (2, ""), (3, "one two three"), (4, "word " * 5000)]) \
        .selectExpr("*", "1 AS piece", "2 AS offset", "3 AS length")
    ids = {r["doc_id"]: encode(r["text"]) for r in docs.collect()}
    for shard in (1 << 16, 2):
        rows = packing.best_fit_packing(docs, shard=shard).collect()
        check(rows, ids, 2048)
    check(packing.best_fit_packing(docs, length=64).collect(), ids, 64)


def test_repeated_and_null_ids(make_docs):
    big = (1 << 53) + 1
    rows = packing.best_fit_packing(make_docs([(big, "a b"), (big, "a b"), (None, "c")])).collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, big, big]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


def test_empty_table(make_docs):
    assert packing.best_fit_packing(make_docs([])).collect() == []

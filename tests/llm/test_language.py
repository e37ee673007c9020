"""Hierarchical language identification: held-out accuracy and awkward rows."""

import zlib

import numpy as np
import pytest
from llm_fixtures import SF_SMALL, documents, make_docs  # noqa: F401

from tidewatch.llm import language


@pytest.fixture(scope="module")
def model(documents):
    return language.fit(documents)


def test_query_is_right_on_held_out_rows(spark, documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = language.query(spark, SF_SMALL).collect()
    assert {r["doc_id"] for r in rows} == set(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.95


def test_families_then_pairs(model):
    assert model["families"] == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert set(model["pairs"]) == {("germanic", "romance"), ("de", "en"), ("es", "fr")}


def test_only_the_text_counts(spark, documents, model):
    some = documents.limit(40)
    plain = language.predict(some, model).select("doc_id", "lang_pred", "score").collect()
    other = some.selectExpr("doc_id", "text", "'xx' AS lang", "'y' AS source")
    again = language.predict(other, model).select("doc_id", "lang_pred", "score").collect()
    assert sorted(plain) == sorted(again)


def test_awkward_rows(make_docs, model):
    docs = make_docs([(1, None), (2, ""), (3, "123 !?\n"), (4, "é"), (None, "the and of that"),
                      (5, "the and of that with this"), (5, "the and of that with this"),
                      (6, "word " * 30_000)]).selectExpr("*", "9 AS score", "'q' AS lang_pred", "1 AS __said", "2 AS said")
    rows = language.predict(docs, model).collect()
    said = [(r["doc_id"], r["lang_pred"]) for r in rows]
    assert [x for x in said if x[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")]
    assert dict(said)[4] in ("de", "en", "es", "fr")
    assert said.count((5, "en")) == 2 and len(rows) == 8
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")


def test_nothing_to_learn(make_docs):
    for docs in (make_docs([]), make_docs([(1, "a", None), (None, "b", "en")])):
        empty = language.fit(docs)
        assert [r["lang_pred"] for r in language.predict(docs, empty).collect()] \
            == ["und"] * docs.count()


def test_one_language_needs_no_pair(make_docs):
    docs = make_docs([(k, "some words here", "en") for k in range(1, 8)])
    got = language.predict(docs, language.fit(docs)).select("lang_pred", "score").distinct().collect()
    assert [tuple(r) for r in got] == [("en", 1.0)]


def test_unlisted_language_is_its_own_family():
    assert language.family_of("xx") == "=xx"
    assert language.family_of("pt") == language.family_of("fr")


def test_svm_separates():
    rng = np.random.default_rng(0)
    rows, signs = [], []
    for k in range(60):
        sign = 1 if k % 2 else -1
        at = np.sort(rng.choice(50, 5, replace=False)) + (100 if sign > 0 else 0)
        rows.append((at, np.full(5, 5 ** -0.5)))
        signs.append(sign)
    w = language.svm(rows, np.array(signs))
    assert all(s * (w[a] @ x + w[language.DIM]) > 0 for (a, x), s in zip(rows, signs))

"""The corpus pipeline against a brute-force run, and on awkward tables."""

import re

import pytest
from llm_fixtures import SF_SMALL, documents, make_docs  # noqa: F401
from test_decontaminate import slow as slow_contained
from test_packing import check
from test_simhash import slow_components, slow_fingerprint
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tidewatch.llm import language, packing, pii, simhash
from tidewatch.llm.common import written


def slow_corpus(rows, items, model):
    """(id, text) rows that reach the last stage, from a table of unique ids."""
    said = language.predictor(model)([t for _, t in rows])
    rows = [r for r, (lang, score) in zip(rows, said)
            if any(c.isalpha() for c in r[1] or "") and score >= corpus_pipeline.MIN_SCORE]
    groups = slow_components([(d, slow_fingerprint(t)) for d, t in rows])
    rows = [(d, t) for (d, t), g in zip(rows, groups) if d == g]
    leaks = {d for d, *_ in slow_contained(rows, items)}
    return {d: pii.masked(t) for d, t in rows if d not in leaks}


def test_run_matches_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    items = [(r["item_id"], r["text"]) for r in
             spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    want = slow_corpus(rows, items, language.fit(documents))
    assert 0 < len(want) < len(rows)
    tok = Tokenizer.from_file(packing.tokenizer_paths()[0])
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in want.items()}
    check(corpus_pipeline.run(spark, SF_SMALL).collect(), ids, 2048)


def test_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "benchmark_decontamination",
                     "pii_deobfuscation", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def through(spark, docs):
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = written(stage(spark, docs, SF_SMALL), name)
        assert docs.columns == columns
        seen.append(docs)
    return seen


def test_awkward_documents(spark, make_docs):
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").first()["text"]
    docs = make_docs([
        (1, None), (2, ""), (3, "12 34"), (None, "the and of that in the"), (4, "mail a@b.co or call me"),
        (5, "mail a@b.co or call me"), (5, "mail a@b.co or call me"), (6, f"x {item} y"),
        (7, "and the " + "thing other than that " * 8000), (None, None)]) \
        .selectExpr("*", "1 AS fp", "'k' AS lang_pred", "2 AS score", "3 AS item_id", "4 AS masked",
                    "5 AS text_hash", "6 AS piece")
    lang, near, clean, masked = through(spark, docs)
    assert sorted(str(r["doc_id"]) for r in lang.collect()) == ["4", "5", "5", "6", "7", "None"]
    assert sorted(str(r["doc_id"]) for r in near.collect()) == ["4", "6", "7", "None"]
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == ["4", "7", "None"]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in masked.collect()}
    assert got[4] == ("mail [EMAIL] or call me", 23)
    rows = corpus_pipeline.STAGES[-1][1](spark, masked, SF_SMALL).collect()
    assert {r["doc_id"] for r in rows} == {4, 7, None}


def test_rejects_by_the_score(spark, documents, monkeypatch):
    """The stage keeps what scores at least MIN_SCORE; at the default nearly every clean
    document, at a higher one fewer."""
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    said = dict(zip(texts, language.predictor(language.fit(documents))(list(texts.values()))))
    lettered = {d for d, (lang, _) in said.items() if lang != language.UNKNOWN}
    sizes = []
    for bar in (corpus_pipeline.MIN_SCORE, 0.97):
        monkeypatch.setattr(corpus_pipeline, "MIN_SCORE", bar)
        kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, documents, SF_SMALL)
                .select("doc_id").collect()}
        assert kept == {d for d in lettered if said[d][1] >= bar}
        sizes.append(len(kept))
    assert sizes[0] >= 0.999 * len(lettered) > sizes[1] > 0


def test_nothing_learned_keeps_every_text_with_a_letter(spark, make_docs):
    docs = make_docs([(1, None, None), (2, "12 34", None), (3, "some text", None), (4, "\u00e9", None)])
    kept = corpus_pipeline.identify_language(spark, docs, SF_SMALL)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4]


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_near_copies_go_whichever_way_they_are_met(spark, documents, broadcast_rows):
    """Above and below the size that is broadcast: the same rows, each once."""
    twice = documents.unionAll(documents.limit(50))
    got = simhash.drop_near_duplicates(twice, broadcast_rows=broadcast_rows).collect()
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    groups = slow_components([(d, slow_fingerprint(t)) for d, t in rows])
    assert sorted(r["doc_id"] for r in got) == sorted({d for (d, _), g in zip(rows, groups) if d == g})


def test_empty_documents(spark, make_docs):
    last = through(spark, make_docs([]))[-1]
    assert corpus_pipeline.STAGES[-1][1](spark, last, SF_SMALL).collect() == []


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", name)) for name in names) == 1
    assert {"op4_warc_derivatives", "op5_benchmark_decontamination", "op6_exact_top_k",
            "op9_url_filter"} <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["pipeline"])
def test_registered_run(name):
    assert entry.queries()[name] is corpus_pipeline.run

"""Co-trained quality classifier: held-out accuracy, calibration, awkward rows."""

import numpy as np
import pytest
from llm_fixtures import SF_SMALL
from llm_fixtures import documents, make_docs  # noqa: F401

from tidewatch.llm import quality


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def more_documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(more_documents, labels):
    return quality.fit(more_documents, labels.filter("doc_id % 3 <> 0"))


def test_held_out_accuracy(more_documents, labels, model):
    held = {r["doc_id"]: r["quality"] for r in labels.filter("doc_id % 3 = 0").collect()}
    rows = [r for r in quality.score(more_documents, model).collect() if r["doc_id"] in held]
    right = np.mean([r["keep"] == (held[r["doc_id"]] == 1) for r in rows])
    text = np.mean([(r["text_score"] >= 0.5) == (held[r["doc_id"]] == 1) for r in rows])
    assert right >= 0.95 and right >= text - 0.01


def test_every_row_is_scored(spark):
    rows = quality.query(spark, SF_SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert all(0 <= r[c] <= 1 for r in rows for c in ("text_score", "meta_score", "score"))


def test_views_teach_each_other():
    """A view that cannot learn from two labels alone gains from the other's."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 900)
    first = rng.normal(0, 1, (900, 4)).astype(np.float32) + 4 * y[:, None]
    second = rng.normal(0, 1, (900, 30)).astype(np.float32)
    second[:, 7] += 3 * y
    n, m = slice(0, 60), slice(60, 600)
    aside = np.arange(60) % 4 == 0
    args = ([first[n], second[n]], y[n].astype(np.float32),
            quality.LocalRows([first[m], second[m]], np.arange(540)), aside)
    taught, alone = quality.co_train(*args), quality.co_train(*args, rounds=0)

    def accuracy(model):
        return np.mean((quality._odds(second[600:], model["models"][1]) > 0) == y[600:])
    assert taught["handed"][0] > 50
    assert accuracy(taught) > accuracy(alone)


def test_spark_rounds_equal_those_of_one_task(spark, more_documents, labels):
    """The same co-training over rows in memory: models, calibration and gifts."""
    feats = quality.featured(more_documents)
    model = quality.fit(more_documents, labels, labelled=80, features=feats)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = feats.toPandas()
    xs = quality._matrices(list(rows["text"]), list(rows["meta"]))
    drawn = {r["id"] for r in spark.createDataFrame([(int(d),) for d in known], "id long").filter(
        f"pmod(xxhash64('labelled', id), {1 << 30}) < {min(1 << 30, 80 * (1 << 30) // len(known) + 1)}").collect()}
    mine = rows["id"].isin(drawn).to_numpy()
    order = np.flatnonzero(mine)[np.argsort(rows["key"].to_numpy()[mine], kind="stable")]
    y = np.array([known[i] for i in rows["id"].to_numpy()[order]], dtype=np.float32)
    alone = quality.co_train([x[order] for x in xs], y,
                             quality.LocalRows([x[~mine] for x in xs], rows["key"].to_numpy()[~mine]),
                             rows["key"].to_numpy()[order] % 4 == 0)
    assert model["handed"] == alone["handed"] and sum(alone["handed"]) > 100
    for (w, b), (u, c) in zip(model["models"], alone["models"]):
        assert np.allclose(w, u, atol=1e-4) and b == pytest.approx(c, abs=1e-4)
    by_text = {r["doc_id"]: r["score"] for r in quality.score(more_documents, model).collect()}
    by_features = {r["doc_id"]: r["score"] for r in quality.score_features(feats, model).collect()}
    assert by_text == pytest.approx(by_features, abs=1e-6)


def test_cuts_take_the_likeliest_and_share_out_ties():
    counts = np.zeros(quality.BINS, dtype=np.int64)
    assert quality.cut_of(counts, 5) is None
    counts[quality.BINS - 1], counts[quality.BINS - 9] = 3, 100
    assert quality.cut_of(counts, 3) == (quality.BINS - 1, 1.0)
    assert quality.cut_of(counts, 53) == (quality.BINS - 9, 0.5)
    assert quality.cut_of(counts, 500)[1] == 1.0
    counts[:] = 0
    counts[100] = 9                                   # not sure enough
    assert quality.cut_of(counts, 5) is None


def test_logistic_recovers_odds():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (4000, 2)).astype(np.float32)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(np.float32)
    w, b = quality.logistic(x, y)
    assert np.allclose([*w, b], [2, -1, 0.5], atol=0.25)


def test_awkward_rows(spark, make_docs, model):
    docs = make_docs([(1, None), (2, ""), (None, "a b"), (3, "x" * 100_000), (4, "a"), (4, "a")]) \
        .selectExpr("doc_id", "text", "nullif(lang, 'en') AS lang", "nullif(source, 'src') AS source",
                    "nullif(n_chars, 1) AS n_chars", "1 AS y", "2 AS score", "3 AS keep")
    rows = quality.score(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    assert quality.score(docs.limit(0), model).collect() == []


def test_no_usable_labels(spark, make_docs):
    schema = "doc_id long, quality int"
    docs = make_docs([(k, f"text {k}") for k in range(30)])
    for rows in ([], [(k, 1) for k in range(30)], [(1, 0), (1, 1), (None, 1), (2, None)]):
        model = quality.fit(docs, spark.createDataFrame(rows, schema))
        assert model is None
        got = quality.score(docs, model).collect()
        assert len(got) == 30 and all(r["score"] is None and r["keep"] for r in got)

"""Training job, persistence, preparation and metric edges."""

import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewatch import session as SE
from tidewatch.operators import metrics as M
from tidewatch.operators import model as MD
from tidewatch.operators import prepare as P
from tidewatch.operators import sampling as S
from tidewatch.sources import labelled as L


@pytest.fixture(scope="module")
def training(spark):
    rows = [(float(k % 30), float(k % 7), "xyz"[k % 3], "ab"[k % 30 > 14]) for k in range(900)]
    return spark.createDataFrame(rows, "x double, y double, t string, Label string")


def test_job_splits_whole_and_cuts_train_rows_only(spark, training, tmp_path):
    bundle, done = MD.train_job(training, trees=5, depth=4, classifier_quota=20, synthetic_share=0.1,
                                report_path=str(tmp_path / "report"))
    assert bundle.classes == ["Normal", "a", "b"]
    assert set(bundle.normal_stats) == {"x", "y"}
    assert done["test_accuracy"].first()["rows"] == 90 + 90 + 18
    report = spark.read.option("header", True).csv(str(tmp_path / "report"))
    assert {"a", "b", "Normal", "accuracy", "macro avg", "weighted avg"} == {
        r["class"] for r in report.collect()}


def test_saved_bundle_and_missing_artefacts(spark, training, tmp_path):
    bundle, _ = MD.train_job(training, trees=3, depth=3)
    root = str(tmp_path / "models")
    base = MD.save(bundle, root)
    assert MD.missing_artefacts(spark, base) == []
    back = MD.load(spark, root)
    assert back.kind == "forest" and back.version == bundle.version and back.prep == bundle.prep
    assert MD.missing_artefacts(spark, str(tmp_path / "none")) == [
        "encoder", "prep", "meta", "forest or boosted or softmax"]
    os.rename(os.path.join(base, "forest"), os.path.join(base, "other"))
    assert MD.missing_artefacts(spark, base) == ["forest or boosted or softmax"]
    with pytest.raises(FileNotFoundError):
        MD.load(spark, root)
    os.rename(os.path.join(base, "other"), os.path.join(base, "boosted"))
    assert MD.missing_artefacts(spark, base) == []       # either classifier will do


def test_rare_values_of_a_wide_column_share_an_indicator(spark):
    rows = [(str(k), "ab"[k % 2], k) for k in range(50)] + [("7", "a", 50), ("3", None, 51), (None, "b", 52)]
    df = spark.createDataFrame(rows, "wide string, t string, n int")
    cats = P.fit_categories(df, ["wide", "t"], max_categories=2)
    assert cats == {"wide": ["3", "7", P.OTHER], "t": ["a", "b"]}
    out = P.one_hot(df, cats)
    assert out.columns == ["n", "wide_7", "wide_<other>", "t_b"]
    sums = out.agg(*[F.sum(f"`{c}`").alias(c) for c in out.columns[1:]]).first()
    assert tuple(sums) == (2, 48, 26)
    whole = P.fit_categories(df, ["wide"], max_categories=50)["wide"]
    assert len(whole) == 50 and P.OTHER not in whole
    assert P.fit_categories(df.limit(0), ["wide"]) == {"wide": []} and P.fit_categories(df, []) == {}


def test_ten_thousand_and_one_values(spark):
    df = spark.range(10_001).selectExpr("CAST(id AS STRING) AS wide", "1 AS n", "'x' AS Label")
    cats = P.fit_categories(df, ["wide"])["wide"]
    assert len(cats) == 10_001 and cats[-1] is P.OTHER
    rare = (set(map(str, range(10_001))) - set(cats[:-1])).pop()
    some = P.one_hot(df, {"wide": [cats[0], cats[1], P.OTHER]}).agg(F.sum("`wide_<other>`")).first()
    assert some[0] == 9_999 and rare == "9999"


def test_folding_is_frozen_in_prep(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_CATEGORIES", 2)
    monkeypatch.setattr(P.fit_categories, "__defaults__", (2,))
    df = spark.createDataFrame([("a", "u"), ("a", "v"), ("b", "u"), ("b", "v"), ("c", "u"), ("d", "v")],
                               "t string, Label string")
    prep = P.Prep.from_json(P.Prep.fit(df).to_json())
    assert prep.features == ["t_b", "t_<other>"]
    new = spark.createDataFrame([("zz", "u"), ("b", "u"), (None, "u")], "t string, Label string")
    rows = [r["features"] for r in prep.transform(new).collect()]
    assert rows[0][1] == max(x[1] for x in rows) and rows[1][0] == max(x[0] for x in rows)
    assert len(rows) == 3


def test_alignment_fills_with_the_frozen_type(spark):
    df = spark.createDataFrame([(1, 2.5)], "b int, extra double")
    out = P.align(df, ["a", "b", "t", "f"], None, {"a": "bigint", "t": "string", "f": "float"})
    assert [(f.name, f.dataType.simpleString()) for f in out.schema.fields] == [
        ("a", "bigint"), ("b", "int"), ("t", "string"), ("f", "float")]
    assert tuple(out.first()) == (0, 1, "0", 0.0)


def test_weights_shuffle_nothing(spark, training, capsys):
    w = P.fit_weights(training)
    assert w == {"a": 1.0, "b": 1.0}
    df = training.withColumn("Label", F.when(F.col("x") > 3, F.col("Label")))
    out = P.with_weights(df, {"a": 2.0})
    out.explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Join" not in plan
    assert {r[0]: r[1] for r in out.groupBy("Label").agg(F.max("weight")).collect()} == {
        None: 1.0, "a": 2.0, "b": 1.0}


def test_report_is_one_scan(spark, capsys):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    M.classification_report(labels, "quality", "toxic").explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan
    assert M.classification_report(labels.limit(0), "quality", "toxic").collect() == []


def test_positions_of_ragged_arrays(spark):
    ragged = spark.createDataFrame([([1.0, 2.0],), ([3.0],), (None,), ([],)], "v array<double>")
    overall, per = M.encoding_health(ragged, "v")
    assert [(r["dim"], r["mean"]) for r in per.orderBy("dim").collect()] == [(0, 2.0), (1, 2.0)]
    o = overall.first()
    assert (o["mean"], o["min"], o["max"], o["low_mean_std"]) == (2.0, 1.0, 3.0, False)
    assert abs(o["std"] - (2 / 3) ** 0.5) < 1e-12
    none, _ = M.encoding_health(ragged.limit(0), "v", None)
    assert none.count() <= 1


def test_checkpoint_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Fake:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None
    with pytest.raises(RuntimeError):
        SE.ensure_checkpoint_dir(Fake)
    assert SE.ensure_checkpoint_dir(spark)


def test_paths(spark, tmp_path):
    assert SE.path_exists(spark, str(tmp_path)) and not SE.path_exists(spark, str(tmp_path / "x"))


NARROW = 64


@pytest.fixture(scope="module")
def narrow_fit(training):
    """``fit(kind)``: a job whose cuts narrow groups above 64 rows, and the most rows of a
    class that one window of it ranks for a cut; one job a kind."""
    made = {}

    def fit(kind, **params):
        if kind in made:
            return made[kind]
        ranked, cut, decided = [], S.below_cuts, S._decided

        def narrow_cuts(df, groups, order, cuts, rows_per_range=None, names=None):
            return cut(df, groups, order, cuts, NARROW, names)

        def counted(df, keys, *rest):
            out = decided(df, keys, *rest)
            for c in out[1]:
                ranked.extend(r["count"] for r in out[0].filter(c).groupBy(*keys).count().collect())
            return out
        with pytest.MonkeyPatch.context() as m:
            m.setattr(S, "below_cuts", narrow_cuts)
            m.setattr(S, "_decided", counted)
            made[kind] = (*MD.train_job(training, kind=kind, classifier_quota=100, **params), max(ranked, default=0))
        return made[kind]
    return fit


FOREST = {"trees": 5, "depth": 4}


def test_a_forest_job_ranks_few_rows_of_a_class(narrow_fit):
    _, done, ranked = narrow_fit("forest", **FOREST)
    assert ranked <= NARROW                 # of 288 training rows a class
    gate = done["validation_gate"].first()
    assert (gate["rows"], gate["meets_target"]) == (72 + 72, True)


def test_importances_of_a_job_that_ranks_few_rows(narrow_fit):
    _, done, ranked = narrow_fit("forest", **FOREST)
    found = [r["importance"] for r in done["importances"].collect()]
    assert ranked <= NARROW
    assert len(found) == 4 and abs(sum(found) - 1) < 1e-6 and found == sorted(found, reverse=True)


def test_every_row_is_scored_by_a_job_that_ranks_few_rows(narrow_fit, training):
    bundle, _, ranked = narrow_fit("forest", **FOREST)
    assert ranked <= NARROW
    rows = MD.score(bundle, training).collect()
    assert len(rows) == 900 and all(abs(sum(r["probs"]) - 1) < 1e-6 for r in rows)
    assert all(r["pred_label"] == bundle.classes[r["probs"].index(max(r["probs"]))] for r in rows)


def test_diversity_of_a_job_that_ranks_few_rows(narrow_fit):
    _, done, ranked = narrow_fit("forest", **FOREST)
    d = done["diversity"].first()
    assert ranked <= NARROW
    assert (d["distinct_predicted"], d["single_class"], d["low_confidence_spread"]) == (2, False, False)


def test_confusion_of_a_job_that_ranks_few_rows(narrow_fit):
    _, done, ranked = narrow_fit("forest", **FOREST)
    pairs = {(r["truth"], r["predicted"]): r["count"] for r in done["confusion"].collect()}
    right = sum(n for (t, p), n in pairs.items() if t == p)
    assert ranked <= NARROW
    assert sum(pairs.values()) == 90 + 90 and abs(right / 180 - done["test_accuracy"].first()["accuracy"]) < 1e-9


def test_a_boosted_job_ranks_few_rows_of_a_class(narrow_fit):
    _, done, ranked = narrow_fit("boosted", max_iter=2, depth=3)
    assert ranked <= NARROW
    accuracy = done["test_accuracy"].first()
    assert accuracy["rows"] == 90 + 90 and accuracy["accuracy"] >= 0.8


@pytest.mark.parametrize("how", ["a load", "its own"])
def test_a_binary_forest_scores_in_a_session_that_has_observed(spark, training, tmp_path, how):
    other = spark.newSession()
    rows = other.createDataFrame(training.collect(), training.schema)
    if how == "a load":
        L.write_audited(rows, str(tmp_path / "load"), ["a"])
        assert "load_" not in str([t.name for t in other.catalog.listTables("global_temp")])
    else:
        seen = Observation("seen")
        rows.observe(seen, F.count(F.lit(1)).alias("n")).collect()
        assert seen.get == {"n": 900}
    bundle, done = MD.train_job(rows, trees=3, depth=3)
    assert MD.score(bundle, rows).count() == 900 and done["test_accuracy"].first()["rows"] == 180
    if how == "a load":             # neither does a plain fit meet the observer
        ready = bundle.pipeline.stages[0].transform(MD._vectorise(bundle.prep.transform(rows)).withColumn("weight", F.lit(1.0)))
        fitted = MD.build_classifier(trees=2, depth=2).fit(ready)
        assert len(fitted.transform(ready).select("prediction").collect()) == 900


@pytest.fixture(scope="module")
def union_fit(training):
    """``fit(kind)``: a job whose cuts narrow groups above 64 rows, and the most rows of a
    class that one call of ``below_cuts`` ranks, as its ranked side has them."""
    def fit(kind, **params):
        ranked, cut, union = [], S.below_cuts, type(training).unionByName

        def counted(settled, side, **how):
            ranked.extend(r["count"] for r in side.groupBy("Label").count().collect())
            return union(settled, side, **how)

        def narrow_cuts(df, groups, order, cuts, rows_per_range=None, names=None):
            with pytest.MonkeyPatch.context() as inner:
                inner.setattr(type(df), "unionByName", counted)
                return cut(df, groups, order, cuts, NARROW, names)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(S, "below_cuts", narrow_cuts)
            _, done = MD.train_job(training, kind=kind, classifier_quota=100, **params)
        return done, ranked
    return fit


def test_importances_come_of_samples_that_rank_no_whole_class(union_fit):
    done, ranked = union_fit("forest", **FOREST)
    assert 0 < max(ranked) <= 2 * NARROW        # around two cuts, of 288 training rows a class
    assert abs(sum(r["importance"] for r in done["importances"].collect()) - 1) < 1e-6


def test_a_boosted_job_ranks_no_whole_class(union_fit):
    done, ranked = union_fit("boosted", max_iter=2, depth=3)
    assert 0 < max(ranked) <= 2 * NARROW
    accuracy = done["test_accuracy"].first()
    assert accuracy["rows"] == 90 + 90 and accuracy["accuracy"] >= 0.8

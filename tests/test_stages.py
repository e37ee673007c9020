"""Preparation as a pipeline stage: raw rows to a named class in one model that is saved,
loaded and applied."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.sql import functions as F

from tidewatch.operators import model as MD
from tidewatch.operators import prepare as P
from tidewatch.operators import stages as ST
from tidewatch.operators.boosting import SoftmaxBoost
from tidewatch.operators.encoder import NeuralEncoder

COLS = ["n", "label_idx", "pred_idx", "pred_label", "features"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, float(k % 30), None if k % 11 == 0 else float(k % 7), "xyz"[k % 3], "ab"[k % 30 > 14],
             1.0 + k % 2, k % 5 == 0) for k in range(400)]
    return spark.createDataFrame(data, "n int, x double, y double, t string, Label string, "
                                       "weight double, is_val boolean")


def scored(model, df):
    return sorted((*[tuple(r[c]) if c == "features" else r[c] for c in COLS], round(r["pred_prob"], 9))
                  for r in model.transform(df).collect())


def test_stage_prepares_as_prep_does(spark, rows):
    keep = ["n", "weight", "is_val"]
    model = ST.Preparation(keep=keep).fit(rows)
    plain = P.Prep.fit(rows.drop(*keep))
    assert model.prep == plain and model.classes == ["a", "b"]
    want = {r["n"]: r["features"] for r in plain.transform(rows, keep=keep).collect()}
    got = model.transform(rows).collect()
    assert {r["n"]: r["features"] for r in got} == want and len(got) == 400
    assert all(r["fvec"].toArray().tolist() == r["features"] for r in got)
    # as scoring meets it: no label, a column missing, another clashing, in another order
    odd = rows.select(F.lit(1).alias("extra"), "t", "x", "n")
    assert [c for c in model.transform(odd).columns if c in ("label_idx", "extra")] == []
    assert model.transform(odd.limit(0)).collect() == []
    assert "Exchange" not in model.transform(rows)._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind", ["own", "spark"])
def test_pipeline_is_saved_loaded_and_applied_as_one(spark, rows, tmp_path, kind):
    prep = ST.Preparation(keep=["n", "weight", "is_val"])
    later = [NeuralEncoder(latent=3, hidden=(8,), epochs=2), SoftmaxBoost(classes=2, rounds=3, depth=2)] \
        if kind == "own" else [
            PCA(k=2, inputCol="fvec", outputCol="latent"),
            RandomForestClassifier(featuresCol="latent", labelCol="label_idx", weightCol="weight",
                                   numTrees=3, seed=1)]
    fitted = Pipeline(stages=[prep, *later]).fit(rows)
    whole = PipelineModel([*fitted.stages, ST.ClassNames(fitted.stages[0].classes)])
    path = str(tmp_path / "model")
    whole.write().save(path)
    back = PipelineModel.load(path)
    assert [type(s) for s in back.stages] == [type(s) for s in whole.stages]
    assert [s.uid for s in back.stages if isinstance(s, ST._Stated)] == [
        s.uid for s in whole.stages if isinstance(s, ST._Stated)]
    assert scored(back, rows) == scored(whole, rows)
    whole.write().overwrite().save(path)
    assert scored(PipelineModel.load(path), rows) == scored(whole, rows)


def test_an_unfitted_stage_and_folded_categories_read_back(spark, tmp_path):
    stage = ST.Preparation(label="y", features=["a", "b"], keep=["k"], outputCol="v")
    stage.write().save(str(tmp_path / "stage"))
    back = ST.Preparation.load(str(tmp_path / "stage"))
    assert back.state() == stage.state() and back.uid == stage.uid
    prep = P.Prep(features=["a_<other>"], raw_features=["a"], categories={"a": ["x", P.OTHER]},
                  scaler={"a_<other>": (0.0, 1.0)}, classes=["p"], label="y", types={"a": "string"})
    model = ST.PreparationModel(prep)
    model.write().save(str(tmp_path / "model"))
    again = ST.PreparationModel.load(str(tmp_path / "model"))
    df = spark.createDataFrame([("x", "p"), ("q", "p"), (None, "z")], "a string, y string")
    assert again.prep == prep
    got = [(r["features"], r["label_idx"]) for r in again.transform(df).collect()]
    assert sorted(got, key=str) == sorted([([0.0], 0), ([1.0], 0), ([1.0], None)], key=str)


def test_a_trained_bundle_as_one_model(spark, rows, tmp_path):
    data = rows.select("n", "x", "y", "t", "Label")
    for kind, more in (("forest", {"trees": 3}), ("boosted", {"max_iter": 2})):
        bundle, _ = MD.train_job(data.drop("n"), kind=kind, depth=3, **more)
        path = str(tmp_path / kind)
        ST.whole_pipeline(bundle, keep=["n"]).write().save(path)
        got = PipelineModel.load(path).transform(data)
        want = MD.score(bundle, data, keep=["n"])
        pick = ["n", "pred_label", F.round("pred_prob", 9).alias("p")]
        assert got.select(*pick).exceptAll(want.select(*pick)).count() == 0
        assert got.count() == want.count() == 400

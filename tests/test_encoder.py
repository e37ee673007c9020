"""The neural encoder: gradients by differences, against PCA, stopping, persistence, samples."""

import os

import numpy as np
import pytest
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidewatch.operators import encoder as E
from tidewatch.operators import model as MD


def test_gradient_by_finite_differences():
    params = E.EncoderParams(hidden=(7, 5), latent=3)
    sizes = E.layer_sizes(6, params)
    rng = np.random.default_rng(0)
    theta = E.first_parameters(sizes, 1) + rng.normal(0, 0.1, sum(a * b + b for a, b in sizes))
    x = rng.normal(0, 1, (9, 6))
    for masks in (None, E.dropout_masks(9, sizes, 0.4, [1])):
        _, grad = E.loss_and_gradient(theta, x, sizes, masks)
        for k in rng.choice(len(theta), 60, replace=False):
            up, down = theta.copy(), theta.copy()
            up[k] += 1e-6
            down[k] -= 1e-6
            slope = (E.loss_and_gradient(up, x, sizes, masks)[0]
                     - E.loss_and_gradient(down, x, sizes, masks)[0]) / 2e-6
            assert slope == pytest.approx(grad[k], rel=1e-4, abs=1e-6)


def curved(n=1500, features=200, seed=0):
    """Rows on a curved surface of two dimensions, in 200."""
    rng = np.random.default_rng(seed)
    z, a, b = rng.uniform(-1, 1, (n, 2)), rng.normal(0, 1, (2, features)), rng.uniform(-1, 1, features)
    x = np.exp(-((z @ a + b) * 8) ** 2)
    return ((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-3)).round(4)


def test_beats_pca_of_equal_width_on_a_curved_surface(spark, tmp_path):
    rows = [(v.tolist(), k % 5 == 0) for k, v in enumerate(curved())]
    df = spark.createDataFrame(rows, "x array<double>, is_val boolean") \
        .withColumn("fvec", array_to_vector("x")).repartition(4)
    model = E.NeuralEncoder(epochs=75, steps=2, rate=0.005, dropout=0.0, l1=0.0, l2=0.0).fit(df)
    held = df.filter("is_val")
    latent = model.transform(held)
    assert latent.select(F.size(vector_to_array("latent")).alias("n")).distinct().collect() == [(48,)]

    def error(xhat):
        return np.mean([(np.array(r["x"]) - np.array(r["h"])) ** 2 for r in xhat.collect()])
    mine = error(latent.select("x", model.decoded(vector_to_array("latent")).alias("h")))
    pca = PCA(k=48, inputCol="fvec", outputCol="p").fit(df.filter("NOT is_val"))
    pc = pca.pc.toArray()
    theirs = np.mean([(np.array(r["x"]) - pc @ r["p"].toArray()) ** 2 for r in pca.transform(held).collect()])
    assert mine < theirs
    losses = [h["validation_loss"] for h in model.history]
    assert min(losses) == pytest.approx(mine, rel=1e-3)
    path = str(tmp_path / "encoder")
    model.write().overwrite().save(path)
    back = E.NeuralEncoderModel.load(path)
    assert np.array_equal(back.theta, model.theta) and back.network == model.network
    assert back.transform(held).select("latent").collect() == latent.select("latent").collect()


def test_gradient_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    params = E.EncoderParams(hidden=(8, 6), latent=3, dropout=0.0)
    sizes = E.layer_sizes(5, params)
    theta = E.first_parameters(sizes, 3)
    x = rng.normal(0, 1, (300, 5)).round(3)
    df = spark.createDataFrame([(v.tolist(), 0) for v in x], "x array<float>, slice int")
    loss, grad = E.loss_and_gradient(theta.astype(np.float32), x.astype(np.float32), sizes)
    for n in (1, 6):
        said, got = E._step(df.repartition(n), theta, sizes, params, 0)
        assert said[1] == 300 and said[0] == pytest.approx(loss, rel=1e-5)
        assert got == pytest.approx(grad.astype(float), rel=1e-3, abs=1e-3)


def test_halves_the_rate_stops_and_puts_the_best_back(spark):
    rng = np.random.default_rng(2)
    rows = [(rng.normal(0, 1, 4).tolist(), k < 20) for k in range(40)]
    df = spark.createDataFrame(rows, "x array<double>, is_val boolean")
    params = E.EncoderParams(hidden=(8, 6), latent=4, epochs=40, steps=1, rate=0.5, plateau=2, patience=5)
    theta, history = E.train(df, 4, params)
    loss = [h["validation_loss"] for h in history]
    best = loss.index(min(loss))
    assert len(history) == best + 1 + params.patience < params.epochs
    assert history[-1]["rate"] < 0.5
    x = np.array([r[0] for r in rows if r[1]], dtype=np.float32)
    sizes, t = E.layer_sizes(4, params), theta.astype(np.float32)
    assert ((E.decode(t, E.encode(t, x, sizes), sizes) - x) ** 2).mean() == pytest.approx(loss[best], rel=1e-4)


def test_awkward_rows(spark):
    params = E.EncoderParams(hidden=(4, 3), latent=2, epochs=1, steps=2)
    rows = [([None, float("nan"), 1.0], None), ([float("inf"), 2.0, 1.0], False)]
    theta, history = E.train(spark.createDataFrame(rows, "x array<double>, is_val boolean"), 3, params)
    assert np.isfinite(theta).all() and len(history) == 2
    first, history = E.train(spark.createDataFrame([], "x array<double>, is_val boolean"), 3, params)
    assert history == [] and np.array_equal(first, E.first_parameters(E.layer_sizes(3, params), params.seed))


@pytest.fixture(scope="module")
def training(spark):
    rows = [(float(k % 30), float(k % 7), "xyz"[k % 3], "ab"[k % 30 > 14]) for k in range(900)]
    return spark.createDataFrame(rows, "x double, y double, t string, Label string")


def test_samples_are_nested_and_exact(spark, training):
    train = training.withColumn("n", F.monotonically_increasing_id())
    for per_range in (1 << 20, 50):
        got = MD.training_samples(train, 100, 300, rows_per_range=per_range).groupBy("Label").agg(
            *[F.count_if(F.col(c)).alias(c) for c in MD.SAMPLES], F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(MD.SAMPLES[0]) & ~F.col(MD.SAMPLES[1])).alias("outside"))
        assert {tuple(r) for r in got.collect()} == {("a", 100, 300, 300, 0), ("b", 100, 300, 300, 0)}
    whole = MD.training_samples(train, None, 10)
    assert whole.count() == 900 and whole.filter(MD.SAMPLES[1]).count() == 20
    assert MD.encoder_quota(13_500_000, 9) == 150_000 and MD.encoder_quota(1000, 9) == 111


def test_job_with_neural_encoder_and_softmax_survives_a_crash_between_artefacts(spark, training, tmp_path):
    """A version is whole once its manifest is written; load falls back to the newest
    whole one, and refuses a broken one by name."""
    bundle, done = MD.train_job(training, kind="softmax", encoder="neural", batch_size=200, classifier_quota=250,
                                encoder_params={"epochs": 3, "steps": 1, "hidden": (8, 6)}, latent=6,
                                rounds=4, rate=0.3, depth=3, patience=3)
    assert bundle.encoder == "neural" and done["test_accuracy"].first()["rows"] == 180
    assert done["test_accuracy"].first()["accuracy"] > 0.7
    assert done["reconstruction"].first()["mse"] > 0
    root = str(tmp_path / "models")
    MD.save(bundle, root)
    scored = {tuple(r) for r in MD.score(bundle, training).select("pred_label", "pred_prob").collect()}
    back = MD.load(spark, root)
    assert back.encoder == "neural" and back.kind == "softmax"
    assert {tuple(r) for r in MD.score(back, training).select("pred_label", "pred_prob").collect()} == scored

    bundle.version = "99999999_torn"
    base = MD.save(bundle, root)
    assert MD.load(spark, root).version == "99999999_torn"
    os.rename(os.path.join(base, MD.MANIFEST), str(tmp_path / "gone"))     # the save died before its end
    assert MD.load(spark, root).version == back.version
    with pytest.raises(FileNotFoundError):
        MD.load(spark, root, "99999999_torn")
    os.rename(str(tmp_path / "gone"), os.path.join(base, MD.MANIFEST))
    part = next(os.path.join(base, "meta", f) for f in os.listdir(os.path.join(base, "meta")) if f.startswith("part"))
    os.remove(os.path.join(base, "meta", "." + os.path.basename(part) + ".crc"))
    with open(part, "a") as f:
        f.write("\n")                                                       # a file that changed since
    assert MD.load(spark, root).version == back.version

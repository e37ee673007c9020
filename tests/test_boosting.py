"""Histogram boosting: against one task, stopping and roll-back, persistence, edges."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidewatch.operators import boosting as B

SCHEMA = "x array<double>, label int, weight double, is_val boolean"


def rows_of(n=600, seed=0, noise=0.15, classes=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 5)).round(3)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 3] > 0.6)
    y = np.where(rng.random(n) < noise, rng.integers(0, classes, n), y)
    return [(v.tolist(), int(c), 2.0 if c == 2 else 1.0, bool(k % 5 == 0)) for k, (v, c) in enumerate(zip(x, y))]


def one_task(rows, params, classes, cuts):
    """The same fit in one process, on all rows at once, in row order."""
    bins = B.binned(np.array([r[0] for r in rows]), cuts)
    label, weight = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    train = ~np.array([r[3] for r in rows])
    margins, rounds = np.zeros((len(rows), classes)), []
    for n in range(params.rounds):
        p = B.softmax(margins)
        tree = B.Round.empty(classes, params.depth)
        for level in range(params.depth):
            found = []
            where = tree.leaves(bins)
            for k in range(classes):
                for node in range(1 << level):
                    here = train & (where[k] == node + (1 << level) - 1)
                    if not here.any():
                        continue
                    g = np.rint((p[here, k] - (label[here] == k)) * weight[here] * B.UNIT)
                    h = np.rint(np.maximum(2 * p[here, k] * (1 - p[here, k]), 1e-6) * weight[here] * B.UNIT)
                    for f in range(bins.shape[1]):
                        gh = [np.bincount(bins[here, f], v, params.bins).astype(np.int64) for v in (g, h)]
                        gain, b, gl, hl = B.best_cut(*gh, params)
                        found.append({"class": k, "node": node, "feature": f, "gain": gain, "bin": b, "gl": gl,
                                      "hl": hl, "g": int(g.sum()), "h": int(h.sum())})
            if not B.grow_level(tree, found, level, n, bins.shape[1], params):
                break
        tree.add_to(margins, bins)
        rounds.append(tree)
    return rounds


def same(a, b):
    return len(a) == len(b) and all(np.array_equal(getattr(x, c), getattr(y, c))
                                    for x, y in zip(a, b) for c in ("feature", "cut", "value"))


PARAMS = B.BoostParams(rounds=5, rate=0.3, depth=3, bins=16, row_share=1.0, state_rounds=2, patience=99)


@pytest.mark.parametrize("partitions", [1, 7])
def test_trees_equal_those_of_one_task(spark, partitions):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    cuts, rounds, history = B.fit_boosting(df, 3, PARAMS, 5)
    want = one_task(rows, PARAMS, 3, cuts)
    best = min(range(len(history)), key=lambda k: history[k]["validation_loss"])
    assert len(rounds) == best > 2 and same(rounds, want[:best])
    assert [h["train_rows"] for h in history] == [480] * 6
    assert history[0]["validation_loss"] == pytest.approx(np.log(3), abs=1e-6)
    assert [h["train_loss"] for h in history] == sorted((h["train_loss"] for h in history), reverse=True)


def test_first_tree_is_the_closed_form(spark):
    """One cut of one feature: gain and leaves by hand."""
    rows = [([float(v)], int(v >= 4), 1.0, False) for v in range(10)]
    params = B.BoostParams(rounds=1, rate=1.0, depth=1, bins=11, l2=1.0, min_gain=0.0, min_curvature=0.0,
                           row_share=1.0, column_share=1.0)
    _, (tree,), _ = B.fit_boosting(spark.createDataFrame(rows, SCHEMA), 2, params, 1,
                                   [np.arange(10, dtype=float)])
    # p = 1/2: gradients -+1/2, curvatures 1/2; 4 rows left, 6 right
    assert tree.feature[:, 0].tolist() == [0, 0] and tree.cut[:, 0].tolist() == [3, 3]
    assert tree.value[0, 1:].tolist() == pytest.approx([2 / 3, -3 / 4])
    assert tree.value[1, 1:].tolist() == pytest.approx([-2 / 3, 3 / 4])
    assert tree.gain[0, 0] == pytest.approx(0.5 * (4 / 3 + 9 / 4 - 1 / 6))


def test_stops_after_flat_rounds_and_rolls_back(spark):
    """Labels are noise: the validation loss soon rises; the fit ends ``patience`` rounds
    after its best round and keeps that round."""
    rng = np.random.default_rng(3)
    rows = [(rng.normal(0, 1, 5).tolist(), int(rng.integers(0, 3)), 1.0, k % 2 == 0) for k in range(200)]
    params = B.BoostParams(rounds=40, rate=0.5, depth=3, bins=16, min_gain=0.0, patience=4)
    _, rounds, history = B.fit_boosting(spark.createDataFrame(rows, SCHEMA), 3, params, 5)
    loss = [h["validation_loss"] for h in history]
    best = loss.index(min(loss))
    assert len(rounds) == best and len(history) == best + 1 + params.patience < params.rounds
    assert all(v >= loss[best] for v in loss[best:])


def test_beats_the_forest_on_held_out_log_loss_and_reads_back(spark, tmp_path):
    from pyspark.ml.classification import RandomForestClassifier
    rows = rows_of(2400, 5)
    df = spark.createDataFrame([(*r, k % 4 == 1) for k, r in enumerate(rows)], SCHEMA + ", test boolean") \
        .withColumn("latent", array_to_vector("x")).withColumnRenamed("label", "label_idx")
    train, test = df.filter("NOT test"), df.filter("test")
    model = B.SoftmaxBoost(rounds=25, rate=0.3, depth=4, patience=5).fit(train)
    forest = RandomForestClassifier(featuresCol="latent", labelCol="label_idx", weightCol="weight",
                                    numTrees=20, maxDepth=6, seed=1).fit(train.filter("NOT is_val"))

    def log_loss(scored):
        p = F.get(vector_to_array("probability"), F.col("label_idx"))
        return scored.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15))))).first()[0]
    assert log_loss(model.transform(test)) < log_loss(forest.transform(test))
    assert sum(model.featureImportances.toArray()) == pytest.approx(1)
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    back = B.SoftmaxBoostModel.load(path)
    assert [r["probability"] for r in back.transform(test).collect()] == [
        r["probability"] for r in model.transform(test).collect()]
    assert back.history == model.history


def test_edges(spark):
    params = B.BoostParams(rounds=2, depth=2, bins=8, min_curvature=0.0, min_gain=0.0)
    rows = [([None, float("nan")], 0, 1.0, False), ([1.0, float("inf")], 1, 1.0, None), ([2.0, 0.0], None, 1.0, False),
            ([1.0, 1.0], 7, 1.0, False)] * 3
    cuts, rounds, history = B.fit_boosting(spark.createDataFrame(rows, SCHEMA), 2, params, 2)
    assert history[0]["train_rows"] == 6 and history[0]["validation_loss"] is None and len(rounds) == 2
    cuts, rounds, history = B.fit_boosting(spark.createDataFrame([], SCHEMA), 2, params, 2)
    assert history[0]["train_rows"] == 0
    p = B.SoftmaxBoostModel("latent", cuts, rounds, 2, params, history).probabilities(np.zeros((1, 2)))
    assert p.tolist() == [[0.5, 0.5]]


def test_leaves_match_a_walk_of_each_row():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 256, (300, 3)).astype(np.uint8)[::2]
    trees = B.Round.empty(4, 5)                          # the last class has no cut
    for k in range(3):
        grow = [0]
        while grow:
            i = grow.pop()
            if i < 31 and rng.random() < 0.8:
                trees.feature[k, i], trees.cut[k, i] = rng.integers(0, 3), rng.integers(0, 256)
                grow += [2 * i + 1, 2 * i + 2]
    want = np.zeros((4, len(bins)), dtype=int)
    for k in range(4):
        for r, row in enumerate(bins):
            while trees.feature[k, want[k, r]] >= 0:
                i = want[k, r]
                want[k, r] = 2 * i + 1 + int(row[trees.feature[k, i]] > trees.cut[k, i])
    assert (trees.leaves(bins) == want).all()


def test_rows_of_a_sliced_batch_are_read():
    bins = [bytes([k, k + 1]) for k in range(9)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(9)), pa.array([0] * 9), pa.array([1.0] * 9), pa.array([False] * 9), pa.array(bins),
         pa.array([[]] * 9, pa.list_(pa.float64()))], names=B._STATE_NAMES)
    for kind in (pa.binary(), pa.large_binary()):
        some = batch.set_column(4, "bins", batch.column("bins").cast(kind)).slice(4, 3)
        assert B._columns(some, 3)[4].tolist() == [[4, 5], [5, 6], [6, 7]]

"""Registered model jobs learn from every training row and report every round."""

import random

import numpy as np
import pytest

from tidewatch.operators import boosting as B
from tidewatch.operators import model as MD
from tidewatch.plans import models as Q

CUT = 20          # rows a class that a quota would leave


@pytest.fixture(scope="module")
def lineitem(spark, tmp_path_factory):
    """900 rows, 306, 306 and 288 of which are low, mid and high."""
    rng = random.Random(4)
    rows = [(k // 4, k % 4 + 1, float(k % 50 + 1), round((k % 50 + 1) * rng.uniform(900, 1100), 2),
             rng.randrange(11) / 100, "OF"[k % 2]) for k in range(900)]
    at = str(tmp_path_factory.mktemp("fits"))
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                "l_discount double, l_linestatus string").write.parquet(f"{at}/lineitem.parquet")
    return at


TEST = {"high": 58, "low": 62, "mid": 62}
VALIDATION = {"high": 46, "low": 49, "mid": 49}
TRAIN = {"high": 184, "low": 195, "mid": 195}


@pytest.fixture(scope="module")
def learned(spark, lineitem):
    """``learned(kind)``: rows by class that the registered classifier is fitted on,
    validation rows aside, where a quota would leave ``CUT`` of each; one fit a kind."""
    made = {}

    def rows(kind):
        if kind in made:
            return made[kind]
        build, samples = MD.build_classifier, MD.training_samples

        def counted(*args, **params):
            classifier = build(*args, **params)
            fit = classifier.fit

            def seen(df):
                made[kind] = {r["Label"]: r["count"] for r in df.filter("NOT is_val").groupBy("Label").count().collect()}
                return fit(df)
            classifier.fit = seen
            return classifier

        def cut(train, encoder_rows, classifier_rows, *rest):
            return samples(train, encoder_rows, classifier_rows and CUT, *rest)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(MD, "build_classifier", counted)
            m.setattr(MD, "training_samples", cut)
            Q.lineitem_model(spark, lineitem, kind)
        return made[kind]
    return rows


def test_boosted_accuracy_comes_of_all_training_rows(spark, lineitem, learned):
    assert learned("boosted") == TRAIN
    assert [tuple(r) for r in Q.q_boosted_accuracy(spark, lineitem).collect()] == [(sum(TEST.values()), True)]


def test_diversity_comes_of_all_training_rows(spark, lineitem, learned):
    assert learned("forest") == TRAIN
    assert [tuple(r) for r in Q.q_model_diversity(spark, lineitem).collect()] == [(3, False, False)]


def test_the_gate_comes_of_all_training_rows(spark, lineitem, learned):
    assert learned("forest") == TRAIN
    assert [tuple(r) for r in Q.q_model_gate(spark, lineitem).collect()] == [(sum(VALIDATION.values()), True)]


def test_importances_come_of_all_training_rows(spark, lineitem, learned):
    assert learned("forest") == TRAIN
    assert [tuple(r) for r in Q.q_model_importances(spark, lineitem).collect()] == [(4, True, True)]


def test_softmax_accuracy_comes_of_all_training_rows_in_every_round(spark, lineitem, learned):
    assert learned("softmax") == learned("forest") == TRAIN
    model = Q.lineitem_model(spark, lineitem, "softmax")[0].pipeline.stages[1]
    rows = np.arange(10_000)
    assert all(B._kept(rows, k, model.boost).all() for k in range(len(model.history)))
    assert [tuple(r) for r in Q.q_softmax_accuracy(spark, lineitem).collect()] == [(sum(TEST.values()), True, True)]


def test_history_has_every_round(spark, lineitem, duck):
    """A row for the start and one after each round, as in the SQL."""
    rows = sorted(tuple(r) for r in Q.q_softmax_history(spark, lineitem).collect())
    counts = (sum(TRAIN.values()), sum(VALIDATION.values()))
    assert rows == [(k, *counts, True, True) for k in range(Q.FITS["softmax"]["rounds"] + 1)]
    mine = duck.cursor()
    mine.execute(f"CREATE TEMP VIEW lineitem AS SELECT * FROM read_parquet('{lineitem}/lineitem.parquet/*.parquet')")
    assert rows == sorted(mine.execute(Q.ORACLE["softmax_history"]).fetchall())

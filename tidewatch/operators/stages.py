"""Preparation and class names as Spark ML stages (T2, T3, T4, T10): one
``PipelineModel`` from raw rows to a named class, saved, loaded and applied as one.

    Pipeline(stages=[Preparation(keep=["weight", "is_val"]),
                     NeuralEncoder(), SoftmaxBoost(classes=10)]).fit(rows)

``whole_pipeline`` makes such a model of a trained bundle. The stages' state lies in
their metadata, next to what Spark ML writes of the others.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import (DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import DataFrame, SparkSession

from . import metrics as M
from . import prepare as P
from .model import Bundle, _softmax


class _Writer(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession,
                                         extraMetadata={"state": self.stage.state()})


class _Reader(MLReader):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def load(self, path: str):
        found = DefaultParamsReader.loadMetadata(path, SparkSession.getActiveSession())
        made = self.stage.from_state(found["state"])
        return made._resetUid(found["uid"])


class _Stated(MLWritable, MLReadable):
    """A stage that is its ``state()``: plain values, kept in the metadata."""

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)

    @classmethod
    def from_state(cls, state: dict):
        return cls(**state)


class Preparation(_Stated, Estimator):
    """Fits ``prepare.Prep``: cleaning, alignment, categories, scaler and label codes.
    ``features`` names the raw feature columns; without it they are all but the label and
    ``keep``, the columns that pass through untouched."""

    def __init__(self, label: str = P.LABEL, features: list[str] | None = None,
                 keep: list[str] | tuple = (), outputCol: str = "fvec"):
        super().__init__()
        self.label, self.features, self.keep, self.outputCol = label, features, list(keep), outputCol

    def state(self) -> dict:
        return {"label": self.label, "features": self.features, "keep": self.keep,
                "outputCol": self.outputCol}

    def _fit(self, df: DataFrame) -> "PreparationModel":
        aside = {self.label, *self.keep}
        names = self.features or [c for c in df.columns if c not in aside]
        data = df.select(*[c for c in df.columns if c in {*names, self.label}])
        return PreparationModel(P.Prep.fit(data, names, self.label), self.keep, self.outputCol)


class PreparationModel(_Stated, Model):
    """Raw rows to ``features``, their vector, ``label_idx`` where the label is there,
    and the kept columns. Narrow: no row is shuffled."""

    def __init__(self, prep: P.Prep, keep: list[str] | tuple = (), outputCol: str = "fvec"):
        super().__init__()
        self.prep, self.keep, self.outputCol = prep, list(keep), outputCol

    def state(self) -> dict:
        return {"prep": json.loads(self.prep.to_json()), "keep": self.keep, "outputCol": self.outputCol}

    @classmethod
    def from_state(cls, state: dict):
        return cls(P.Prep.from_json(json.dumps(state["prep"])), state["keep"], state["outputCol"])

    @property
    def classes(self) -> list[str]:
        return self.prep.classes

    def _transform(self, df: DataFrame) -> DataFrame:
        made = self.prep.transform(df, keep=self.keep)
        return made.withColumn(self.outputCol, array_to_vector("features"))


class ClassNames(_Stated, Transformer):
    """A classifier's output as ``probs``, ``pred_idx``, ``pred_prob`` and ``pred_label``.
    ``raw`` softmaxes raw scores, for classifiers whose probabilities do not sum to one."""

    def __init__(self, classes: list[str], raw: bool = False):
        super().__init__()
        self.classes, self.raw = list(classes), raw

    def state(self) -> dict:
        return {"classes": self.classes, "raw": self.raw}

    def _transform(self, df: DataFrame) -> DataFrame:
        probs = _softmax() if self.raw else vector_to_array("probability")
        return P.index_label(M.with_argmax(df.withColumn("probs", probs), "probs"), self.classes)


def whole_pipeline(bundle: Bundle, keep: list[str] | tuple = ()) -> PipelineModel:
    """A trained bundle as one model: preparation, encoder, classifier, class names."""
    return PipelineModel([PreparationModel(bundle.prep, keep), *bundle.pipeline.stages,
                          ClassNames(bundle.classes, raw=bundle.kind == "boosted")])

"""Models: encoding, weighted classifier, scoring, persistence (T5-T14, A23,
A26, O3, O5, S9-S11, J6).

A model is an encoder and a classifier. Encoders: ``neural``, the nonlinear
48-wide network of ``encoder.py``, or ``pca``, ``PCA(k=min(48, features))``, each
with its inverse for the reconstruction check. Classifiers: ``softmax``, the
jointly boosted multiclass trees of ``boosting.py``; ``forest``, a class-weighted
``RandomForestClassifier``; ``boosted``, ``OneVsRest(GBTClassifier)``, whose raw
scores are turned into probabilities by softmax. Fits run as distributed jobs;
the driver holds only fitted parameters.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (GBTClassifier, OneVsRest, OneVsRestModel,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ATTACK_DESCRIPTIONS
from ..session import path_exists, shared_path
from . import metrics as M
from . import prepare as P
from . import sampling as S
from .boosting import SoftmaxBoost, SoftmaxBoostModel
from .encoder import NeuralEncoder, NeuralEncoderModel

LATENT = 48

# Artefacts a saved version must hold; of a group any one will do.
ENCODERS = {"pca": PCAModel, "neural": NeuralEncoderModel}
CLASSIFIERS = {"forest": RandomForestClassificationModel, "boosted": OneVsRestModel,
               "softmax": SoftmaxBoostModel}
ENCODER_QUOTA = 150_000      # rows a class that the encoder sees, of the batch mode
REQUIRED_ARTEFACTS = [("encoder",), ("prep",), ("meta",), tuple(CLASSIFIERS)]


@dataclass
class Bundle:
    prep: P.Prep
    pipeline: PipelineModel
    kind: str
    version: str
    normal_stats: dict | None = None

    @property
    def classes(self):
        return self.prep.classes

    @property
    def encoder(self) -> str:
        return next(k for k, c in ENCODERS.items() if isinstance(self.pipeline.stages[0], c))


def _vectorise(df: DataFrame) -> DataFrame:
    return df.withColumn("fvec", array_to_vector("features"))


def _softmax(raw: str = "rawPrediction", out: str = "probs"):
    """Softmax of a raw score vector into an array of probabilities."""
    arr = vector_to_array(F.col(raw))
    mx = F.array_max(arr)
    ex = F.transform(arr, lambda x: F.exp(x - mx))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, b: a + b)
    return F.transform(ex, lambda x: x / tot).alias(out)


def build_encoder(n_features: int, encoder: str = "pca", latent: int = LATENT, seed: int = 42,
                  **params):
    """The encoder to fit (T5); a neural one may be wider than its input."""
    if encoder == "pca":
        return PCA(k=max(1, min(latent, n_features)), inputCol="fvec", outputCol="latent")
    if encoder == "neural":
        return NeuralEncoder(latent=latent, seed=seed, **params)
    raise ValueError("encoder must be 'pca' or 'neural'")


def build_classifier(kind: str = "forest", classes: int = 0, seed: int = 42, trees: int = 30,
                     depth: int = 6, max_iter: int = 30, **params):
    """The classifier to fit: T6 softmax boosting or a forest, T7 one-vs-rest boosting."""
    if kind == "forest":
        return RandomForestClassifier(featuresCol="latent", labelCol="label_idx",
                                      weightCol="weight", numTrees=trees, maxDepth=depth,
                                      seed=seed, featureSubsetStrategy="sqrt")
    if kind == "boosted":
        gbt = GBTClassifier(featuresCol="latent", maxDepth=depth, maxIter=max_iter,
                            stepSize=0.1, seed=seed,
                            validationIndicatorCol="is_val", validationTol=0.01)
        return OneVsRest(classifier=gbt, featuresCol="latent", labelCol="label_idx",
                         weightCol="weight", parallelism=4)
    if kind == "softmax":
        return SoftmaxBoost(classes=classes, seed=seed, depth=depth, **params)
    raise ValueError("kind must be 'softmax', 'forest' or 'boosted'")


def encoder_quota(batch_size: int, classes: int) -> int:
    """Rows of each class that the encoder of the batch mode sees."""
    return min(ENCODER_QUOTA, batch_size // max(1, classes))


def train_job(df: DataFrame, label: str = P.LABEL, kind: str = "forest",
              classifier_quota: int | None = None, synthetic_share: float = 0.0,
              report_path: str | None = None, seed: int = 42, encoder: str = "pca",
              batch_size: int | None = None, latent: int = LATENT,
              encoder_params: dict | None = None, **params):
    """Train end to end (T11/T12/T13): append synthetic ``Normal`` rows when asked
    and the data has none, fit the preparation on all rows, split 64/16/20 exactly
    by class, weight classes, fit, evaluate, write the report.

    The batch mode bounds the *training* rows: ``batch_size`` those of each class that
    the encoder is fitted on (``encoder_quota``), ``classifier_quota`` those that the
    classifier is fitted on, once the encoder stands. Both samples are the first rows of
    one seeded order, so they are nested, and are cut in one pass. Test and validation
    rows are never cut, nor are the rows behind scaler, categories and weights.
    ``synthetic_share`` is the share of synthetic rows (0.15 in the reference). Prepared
    rows are written to the shared folder and read from there. ``params`` are the
    classifier's. Returns (bundle, evaluation dict of DataFrames).
    """
    data = df.withColumnRenamed(label, P.LABEL) if label != P.LABEL else df
    stats = None
    if synthetic_share:
        numeric = P.numeric_columns(data)
        stats = P.moments_dict(P.feature_moments(P.clean(data), numeric), numeric)
        data = S.with_synthetic_normal(data, stats, int(data.count() * synthetic_share), seed=seed)
    prep = P.Prep.fit(data)
    split = S.three_way_split(data, P.LABEL, seed=seed)
    prepared = _vectorise(prep.transform(split, keep=["split"]))
    weights = P.fit_weights(split.filter(F.col("split") == "train").select(P.LABEL))
    prepared = P.with_weights(prepared, weights).withColumn(
        "is_val", F.col("split") == "validation")
    spark = df.sparkSession
    path = shared_path(spark, "training", uuid.uuid4().hex)
    prepared.write.parquet(path)
    prepared = spark.read.parquet(path)
    held = prepared.filter(F.col("split") == "validation")
    train = prepared.filter(F.col("split") == "train")
    seen, learned = train, train
    if classifier_quota or batch_size:
        marked = training_samples(train, encoder_quota(batch_size, len(prep.classes)) if batch_size else None,
                                  classifier_quota, seed)
        marked.write.parquet(f"{path}-samples")
        marked = spark.read.parquet(f"{path}-samples")
        seen, learned = (marked.filter(c).drop(*SAMPLES) for c in SAMPLES)
    to_encode = build_encoder(len(prep.features), encoder, latent, seed, **(encoder_params or {}))
    encoded = to_encode.fit(seen.unionByName(held) if encoder == "neural" else seen)
    if kind != "forest":       # early stopping looks at the validation rows
        learned = learned.unionByName(held)
    classifier = build_classifier(kind, len(prep.classes), seed, **params).fit(encoded.transform(learned))
    if kind == "forest":       # a copy has no summary, which holds the session in every scoring task
        classifier = classifier.copy()
    pipe = PipelineModel([encoded, classifier])
    version = time.strftime("%Y%m%d_%H%M%S") + f"_{uuid.uuid4().hex[:6]}"
    bundle = Bundle(prep=prep, pipeline=pipe, kind=kind, version=version, normal_stats=stats)
    evaluation = evaluate(bundle, score_prepared(bundle, prepared))
    if report_path:
        M.write_report(evaluation["report"], report_path)
    return bundle, evaluation


SAMPLES = ("in_encoder_sample", "in_classifier_sample")


def training_samples(train: DataFrame, encoder_rows: int | None, classifier_rows: int | None,
                     seed: int = 42, label: str = P.LABEL,
                     rows_per_range: int = S.ROWS_PER_RANGE) -> DataFrame:
    """The rows of ``train`` in either sample, with a flag for each: the first
    ``encoder_rows`` and the first ``classifier_rows`` of every class in one seeded order
    (None: all), cut in one pass."""
    order = [S.seeded_order(train, seed, exclude=["fvec"]),
             *[c for c in train.columns if c != "fvec"]]
    cuts = [(lambda size, n=n: size if n is None else n) for n in (encoder_rows, classifier_rows)]
    out = S.below_cuts(train, [label], order, cuts, rows_per_range, list(SAMPLES))
    return out.filter(" OR ".join(SAMPLES))


def score_prepared(bundle: Bundle, prepared: DataFrame) -> DataFrame:
    """Model output on prepared rows: ``probs`` array, ``pred_idx``,
    ``pred_prob`` and ``pred_label`` (T10, F5, J3)."""
    out = bundle.pipeline.transform(prepared)
    if bundle.kind == "boosted":
        out = out.withColumn("probs", _softmax())
    else:
        out = out.withColumn("probs", vector_to_array("probability"))
    out = M.with_argmax(out, "probs")
    return P.index_label(out, bundle.classes)


def score(bundle: Bundle, df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Score raw rows (flows or table rows) with a fitted bundle."""
    prepared = _vectorise(bundle.prep.transform(df, keep=list(keep)))
    out = score_prepared(bundle, prepared)
    drop = [c for c in ("fvec", "latent", "rawPrediction", "probability", "prediction")
            if c in out.columns]
    return out.drop(*drop)


def evaluate(bundle: Bundle, scored: DataFrame) -> dict:
    """Held-out evaluation tables."""
    test = scored.filter(F.col("split") == "test")
    val = scored.filter(F.col("split") == "validation")
    out = {
        "test_accuracy": M.accuracy(test, "label_idx", "pred_idx"),
        "validation_gate": M.validation_gate(val, "label_idx", "pred_idx"),
        "report": M.classification_report(test, P.LABEL, "pred_label"),
        "confusion": M.confusion(test, P.LABEL, "pred_label"),
        "confidence": M.confidence_stats(test, "pred_prob"),
    }
    div_overall, div_per = M.prediction_diversity(val, "probs")
    out["diversity"] = div_overall
    out["diversity_per_class"] = div_per
    enc = scored.filter(F.col("split") != "test").withColumn("latent_arr", vector_to_array("latent"))
    out["encoding"], out["encoding_per_dim"] = M.encoding_health(enc, "latent_arr", "split")
    out["reconstruction"] = reconstruction(bundle, scored)
    out["importances"] = importances(bundle, scored.sparkSession)
    return out


def reconstruction(bundle: Bundle, prepared_scored: DataFrame) -> DataFrame:
    """Mean squared error of x against its reconstruction."""
    encoder = bundle.pipeline.stages[0]
    lat = vector_to_array(F.col("latent"))
    x = F.transform(F.col("features"), lambda v: v.cast("double"))
    if bundle.encoder == "neural":
        df = prepared_scored.select(x.alias("x"), encoder.decoded(lat).alias("xhat"))
    else:
        pc = encoder.pc.toArray()  # features x k, fit result
        # one array literal per feature, not a literal per cell
        rows = [F.aggregate(F.zip_with(lat, F.lit(np.ascontiguousarray(pc[i])), lambda a, b: a * b),
                            F.lit(0.0), lambda s, x: s + x) for i in range(pc.shape[0])]
        df = prepared_scored.select(x.alias("x"), F.array(*rows).alias("xhat"))
    return M.reconstruction_error(df, "x", "xhat")


def importances(bundle: Bundle, spark: SparkSession, top: int = 20) -> DataFrame:
    """Top ``top`` latent dimensions by importance."""
    clf = bundle.pipeline.stages[-1]
    if hasattr(clf, "featureImportances"):
        imp = clf.featureImportances.toArray().tolist()
    else:  # one-vs-rest: average over the per-class models
        models = clf.models
        imp = [sum(m.featureImportances.toArray()[i] for m in models) / len(models)
               for i in range(models[0].numFeatures)]
    rows = [(f"latent_{i}", float(v)) for i, v in enumerate(imp)]
    return spark.createDataFrame(rows, "feature string, importance double") \
        .orderBy(F.desc("importance"), "feature").limit(top)


# --- persistence (S9, S10, S11, O5, J6) --------------------------------------

def save(bundle: Bundle, root: str, make_current: bool = True) -> str:
    """Write ``<root>/version=<v>/{encoder,<kind>,prep,meta}`` and, when asked, the
    ``current`` pointer row. Nothing is copied."""
    spark = SparkSession.getActiveSession()
    base = os.path.join(root, f"version={bundle.version}")
    encoder, classifier = bundle.pipeline.stages
    encoder.write().overwrite().save(os.path.join(base, "encoder"))
    classifier.write().overwrite().save(os.path.join(base, bundle.kind))
    spark.createDataFrame([(bundle.prep.to_json(),)], "prep string") \
        .coalesce(1).write.mode("overwrite").json(os.path.join(base, "prep"))
    meta = {"version": bundle.version, "kind": bundle.kind, "encoder": bundle.encoder,
            "classes": bundle.classes, "features": bundle.prep.features,
            "descriptions": dict(ATTACK_DESCRIPTIONS),
            "normal_stats": bundle.normal_stats or {}}
    spark.createDataFrame([(bundle.version, json.dumps(meta))], "v string, meta string") \
        .coalesce(1).write.mode("overwrite").json(os.path.join(base, "meta"))
    files = _files(spark, base)
    files.coalesce(1).write.mode("overwrite").json(os.path.join(base, MANIFEST))
    if make_current:
        spark.createDataFrame([(bundle.version,)], "version string") \
            .coalesce(1).write.mode("overwrite").json(os.path.join(root, "current"))
    return base


MANIFEST = "manifest"


def _files(spark: SparkSession, base: str) -> DataFrame:
    """(name, length, digest) of the files under a version, its manifest aside."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    name = F.regexp_extract("path", r"version=[^/]+/(.+)$", 1)
    return files.select(name.alias("name"), "length", F.sha2("content", 256).alias("digest")) \
        .filter(~F.col("name").startswith(f"{MANIFEST}/") & ~F.col("name").rlike(r"(^|/)[._][^/]*$"))


def is_whole(spark: SparkSession, base: str) -> bool:
    """Whether a version was saved to its end and still is what was saved: its manifest,
    which is written last, names every file that is there with its length and digest."""
    if not path_exists(spark, os.path.join(base, MANIFEST, "_SUCCESS")):
        return False
    listed = spark.read.schema("name string, length long, digest string") \
        .json(os.path.join(base, MANIFEST))
    return listed.join(_files(spark, base), ["name", "length", "digest"], "left_anti").isEmpty()


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Saved versions, newest first (O5): partition discovery on ``version=``."""
    return (spark.read.json(os.path.join(root, "version=*", "meta"))
            .select(F.col("v").alias("version")).distinct().orderBy(F.desc("version")))


def load(spark: SparkSession, root: str, version: str | None = None) -> Bundle:
    """Load a version: ``None`` = the newest that is whole (S10), ``'current'`` = pointer
    (S11). A version whose save did not end is no version: the one before is taken. One
    that is asked for by name and is not whole raises."""
    if version is None:
        found = _version_names(spark, root)
        version = next((v for v in found if is_whole(spark, os.path.join(root, f"version={v}"))), None)
        if version is None:
            raise FileNotFoundError(f"no whole version under {root} (found: {found})")
    elif version == "current":
        version = spark.read.json(os.path.join(root, "current")).first()["version"]
    base = os.path.join(root, f"version={version}")
    missing = missing_artefacts(spark, base)
    if missing:
        raise FileNotFoundError(f"version {version} lacks {missing}")
    if not is_whole(spark, base):
        raise FileNotFoundError(f"version {version} differs from its manifest, or has none")
    prep = P.Prep.from_json(spark.read.json(os.path.join(base, "prep")).first()["prep"])
    meta = json.loads(spark.read.json(os.path.join(base, "meta")).first()["meta"])
    # the classifier it was saved with, else whichever is there
    kind = next(k for k in (meta["kind"], *CLASSIFIERS) if path_exists(spark, os.path.join(base, k)))
    pipe = PipelineModel([ENCODERS[meta["encoder"]].load(os.path.join(base, "encoder")),
                          CLASSIFIERS[kind].load(os.path.join(base, kind))])
    stats = {k: tuple(v) for k, v in (meta.get("normal_stats") or {}).items()}
    return Bundle(prep=prep, pipeline=pipe, kind=kind, version=version,
                  normal_stats=stats or None)


def _version_names(spark: SparkSession, root: str) -> list[str]:
    """Names of the version folders, whole or not, newest first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return sorted((n[len("version="):] for n in names if n.startswith("version=")), reverse=True)


def artefact_status(spark: SparkSession, base: str) -> DataFrame:
    """Required artefacts left-anti the ones present (J6): rows are missing. An
    artefact that several can stand for is missing when none of them is there."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load(base).select("path"))
    present = files.select(F.regexp_extract("path", r"version=[^/]+/([^/]+)/", 1).alias("name")).distinct()
    names = spark.createDataFrame([(" or ".join(g), n) for g in REQUIRED_ARTEFACTS for n in g],
                                  "artefact string, name string")
    there = names.join(present, "name", "left_semi").select("artefact")
    return names.select("artefact").distinct().join(there, "artefact", "left_anti")


def missing_artefacts(spark: SparkSession, base: str) -> list[str]:
    """Names of missing artefacts; of a folder that does not exist, all. Any other
    failure to list raises."""
    if not path_exists(spark, base):
        return [" or ".join(g) for g in REQUIRED_ARTEFACTS]
    return sorted(r[0] for r in artefact_status(spark, base).collect())

"""Multiclass softmax boosting by distributed histograms.

A round grows one tree per class, all of them together and level by level. A row's
gradient and curvature of the weighted softmax loss come from its margins; every task
adds them up by (class, node, feature, bin), tasks' histograms are added up by (class,
node, feature), and the best cut of each comes to the driver, which holds nothing but
trees. Gradients are added as integers of ``UNIT``, so the sums, and with them the trees,
do not depend on how rows are dealt or on the order in which tasks end.

Rows are binned once, by quantile cuts over all training rows, into a written table of
one byte a feature. Every ``state_rounds`` rounds the margins are written too, so a pass
applies few trees. A round costs ``depth`` passes over that table; the loss over the
validation rows is taken in the next round's first pass. When it has not fallen for
``patience`` rounds the fit ends, and the model is cut back to its best round.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.util import DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

UNIT = 1 << 24                  # gradients are added in units of 1 / UNIT
TILE = 8192                     # rows whose histograms are added up together
_LOSSES = ("validation_loss", "validation_rows", "validation_wrong",
           "train_loss", "train_rows", "train_wrong")


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 1000
    rate: float = 0.03
    depth: int = 6
    bins: int = 64              # at most 256
    l2: float = 1.0
    min_gain: float = 0.2
    min_curvature: float = 2.0  # of either side of a cut
    row_share: float = 0.8      # rows a round learns from
    column_share: float = 0.8   # features a tree, and again a level, may cut at
    patience: int = 50
    state_rounds: int = 16
    seed: int = 42


@dataclass
class Round:
    """The trees of a round as heaps, (classes, nodes): a node's children are 2i + 1 and
    2i + 2. ``feature`` is -1 at a leaf; rows with a bin up to ``cut`` go left."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(classes: int, depth: int) -> "Round":
        shape = (classes, (1 << (depth + 1)) - 1)
        return Round(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape), np.zeros(shape))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """(classes, rows): the node that each row ends in. All rows go down all levels,
        from a leaf always to the left; ``ends`` names the leaf that they passed."""
        n, width = bins.shape
        flat, rows = np.ascontiguousarray(bins).ravel(), np.arange(n) * width
        out = np.zeros((len(self.feature), n), dtype=np.int64)
        for k, (feature, cut) in enumerate(zip(self.feature, self.cut)):
            cuts = np.flatnonzero(feature >= 0)
            if not len(cuts):
                continue
            ends = np.arange(len(feature))
            for level in range(int(cuts[-1] + 1).bit_length()):
                nodes = np.arange((2 << level) - 1, (4 << level) - 1)
                above = (nodes - 1) // 2
                ends[nodes] = np.where(feature[above] < 0, ends[above], nodes)
            at, most = np.maximum(feature, 0).astype(np.int64), np.where(feature >= 0, cut, 255)
            node = out[k]
            for _ in range(int(cuts[-1] + 1).bit_length()):
                node = 2 * node + 1 + (flat.take(rows + at.take(node)) > most.take(node))
            out[k] = ends.take(node)
        return out

    def add_to(self, margins: np.ndarray, bins: np.ndarray) -> None:
        for k, node in enumerate(self.leaves(bins)):
            margins[:, k] += self.value[k, node]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: the number of cuts below it; what is no number lies lowest."""
    out = np.empty(x.shape, dtype=np.uint8)
    x = np.where(np.isnan(x), -np.inf, x)
    for f, c in enumerate(cuts):
        out[:, f] = np.searchsorted(c, x[:, f], side="left")
    return out


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _kept(row: np.ndarray, round_no: int, params: BoostParams) -> np.ndarray:
    """Which rows a round learns from: by a hash of the row's number and the round."""
    h = (row.astype(np.uint64) + np.uint64(round_no * 0x51_7CC1 + params.seed)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.float64) < params.row_share * (1 << 24)


# ------------------------------------------------------------------ one task

def _columns(batch, classes: int):
    n = batch.num_rows
    column = batch.column("bins")
    _, ends, data = column.buffers()            # the rows' bytes follow one another
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    low, high = ends[column.offset], ends[column.offset + n]
    bins = np.frombuffer(data or b"", dtype=np.uint8)[low:high].reshape(n, -1)
    flat = batch.column("margins").flatten().to_numpy()
    margins = flat.reshape(n, classes).copy() if len(flat) else np.zeros((n, classes))
    return (batch.column("row").to_numpy(), batch.column("label").to_numpy(),
            batch.column("weight").to_numpy(), batch.column("is_val").to_numpy(zero_copy_only=False),
            bins, margins)


def losses(p: np.ndarray, label: np.ndarray, is_val: np.ndarray) -> np.ndarray:
    """Loss in units, rows and wrong rows, of validation and of training rows."""
    loss = np.rint(-np.log(np.maximum(p[np.arange(len(p)), label], 1e-15)) * UNIT).astype(np.int64)
    wrong = p.argmax(axis=1) != label
    return np.array([x for side in (is_val, ~is_val)
                     for x in (loss[side].sum(), side.sum(), wrong[side].sum())], dtype=np.int64)


def add_histograms(total: np.ndarray, p, label, weight, bins, node, level: int) -> None:
    """Adds rows' gradients and curvatures to ``total`` (2, classes, nodes of the level,
    features, bins)."""
    _, classes, nodes, features, width = total.shape
    first = (1 << level) - 1
    offsets = np.arange(features) * width
    for k in range(classes):
        here = np.flatnonzero(node[k] >= first)
        if not len(here):
            continue
        q, w = p[here, k], weight[here]
        g = np.rint((q - (label[here] == k)) * w * UNIT)
        h = np.rint(np.maximum(2 * q * (1 - q), 1e-6) * w * UNIT)
        at = (((node[k, here] - first) * (features * width))[:, None] + offsets + bins[here]).ravel()
        for total_k, v in ((total[0, k], g), (total[1, k], h)):
            # sums of one tile stay below 2**53, so adding doubles is exact
            total_k += np.bincount(at, np.repeat(v, features), nodes * features * width) \
                .astype(np.int64).reshape(total_k.shape)


def _task_histograms(state_rounds: list[Round], growing: Round, level: int, round_no: int,
                     params: BoostParams, features: int, grow: bool):
    classes = len(growing.feature)

    def run(batches):
        total = np.zeros((2, classes, 1 << level, features, params.bins), dtype=np.int64)
        said = np.zeros(len(_LOSSES), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                row, label, weight, is_val, bins, margins = _columns(batch.slice(at, TILE), classes)
                use = np.flatnonzero(~is_val & _kept(row, round_no, params))
                if level:           # losses are taken at the first level, of all rows
                    label, weight, bins, margins = label[use], weight[use], bins[use], margins[use]
                    use = slice(None)
                for r in state_rounds:
                    r.add_to(margins, bins)
                p = softmax(margins)
                if level == 0:
                    said += losses(p, label, is_val)
                if grow:
                    add_histograms(total, p[use], label[use], weight[use], bins[use],
                                   growing.leaves(bins[use]), level)
        out = []
        if level == 0:
            out += [(-1, 0, j, np.array([v]), np.array([0])) for j, v in enumerate(said)]
        if grow:
            for k, node in zip(*np.nonzero(total[1].any(axis=(2, 3)))):
                out += [(k, node, f, total[0, k, node, f], total[1, k, node, f]) for f in range(features)]
        if out:
            k, node, f, g, h = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k, pa.int32()), pa.array(node, pa.int32()), pa.array(f, pa.int32()),
                 pa.array([x.astype("<i8").tobytes() for x in g], pa.binary()),
                 pa.array([x.astype("<i8").tobytes() for x in h], pa.binary())],
                names=["class", "node", "feature", "g", "h"])
    return run


def best_cut(g: np.ndarray, h: np.ndarray, params: BoostParams) -> tuple[float, int, int, int]:
    """(gain, bin, left gradient, left curvature) of the best cut of one histogram, the
    first of equals; a gain of -inf where no cut is allowed."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = int(g.sum()), int(h.sum())

    def part(a, b):
        return (a / UNIT) ** 2 / (b / UNIT + params.l2)
    gain = 0.5 * (part(gl, hl) + part(gt - gl, ht - hl) - part(gt, ht)) - params.min_gain
    fine = (hl >= params.min_curvature * UNIT) & (ht - hl >= params.min_curvature * UNIT)
    gain = np.where(fine, gain, -np.inf)
    if not len(gain):
        return -np.inf, 0, 0, 0
    b = int(gain.argmax())
    return float(gain[b]), b, int(gl[b]), int(hl[b])


def _best_cuts(params: BoostParams):
    """Histograms of a partition that has all of each (class, node, feature)."""
    def run(batches):
        sums: dict = {}
        for batch in batches:
            for key, g, h in zip(zip(*(batch.column(c).to_pylist() for c in ("class", "node", "feature"))),
                                 batch.column("g").to_pylist(), batch.column("h").to_pylist()):
                both = np.stack((np.frombuffer(g, "<i8"), np.frombuffer(h, "<i8")))
                sums[key] = sums[key] + both if key in sums else both
        rows = [(*key, *((0.0, 0, 0, 0) if key[0] < 0 else best_cut(g, h, params)), int(g.sum()), int(h.sum()))
                for key, (g, h) in sums.items()]
        if rows:
            kinds = [pa.int32()] * 3 + [pa.float64(), pa.int32()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             names=_CUT_NAMES)
    return run


_CUT_NAMES = ["class", "node", "feature", "gain", "bin", "gl", "hl", "g", "h"]
_CUTS = "class int, node int, feature int, gain double, bin int, gl long, hl long, g long, h long"
_HIST = "class int, node int, feature int, g binary, h binary"


def _pass(state: DataFrame, state_rounds, growing, level, round_no, params, features, grow=True) -> list[dict]:
    """One pass: a row per (class, node, feature) of the level, and the losses. Only the
    first level's reads the validation rows."""
    rows = state.filter("NOT is_val") if level else state
    hist = rows.mapInArrow(_task_histograms(state_rounds, growing, level, round_no, params, features, grow),
                           _HIST)
    return hist.repartition("class", "node", "feature").mapInArrow(_best_cuts(params), _CUTS) \
        .toArrow().to_pylist()


def _columns_of(round_no: int, k: int, level: int, features: int, params: BoostParams) -> np.ndarray:
    """Features that tree ``k`` of a round may cut at on a level: a share of a share."""
    rng = np.random.default_rng([params.seed, round_no, k])
    tree = rng.permutation(features)[:max(1, round(features * params.column_share))]
    rng = np.random.default_rng([params.seed, round_no, k, level])
    return rng.permutation(tree)[:max(1, round(len(tree) * params.column_share))]


def grow_level(growing: Round, rows: list[dict], level: int, round_no: int, features: int,
               params: BoostParams) -> bool:
    """Cuts the nodes of a level at their best cut, and gives the others and the new
    children their values. Whether anything was cut."""
    first, cut_any = (1 << level) - 1, False
    by_node: dict = {}
    for r in rows:
        if r["class"] >= 0:
            by_node.setdefault((r["class"], r["node"]), []).append(r)

    def leaf(g, h):
        return -params.rate * (g / UNIT) / (h / UNIT + params.l2)
    for (k, node), found in by_node.items():
        at = first + node
        growing.value[k, at] = leaf(found[0]["g"], found[0]["h"])
        allowed = set(_columns_of(round_no, k, level, features, params).tolist())
        best = min((r for r in found if r["feature"] in allowed), key=lambda r: (-r["gain"], r["feature"]))
        if best["gain"] > 0:
            cut_any = True
            growing.feature[k, at], growing.cut[k, at] = best["feature"], best["bin"]
            growing.gain[k, at] = best["gain"]
            growing.value[k, 2 * at + 1] = leaf(best["gl"], best["hl"])
            growing.value[k, 2 * at + 2] = leaf(best["g"] - best["gl"], best["h"] - best["hl"])
    return cut_any


# ----------------------------------------------------------------- the fit

def quantile_cuts(rows: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """Distinct quantiles of each position of the array column ``x``; one pass, partial
    digests a task."""
    shares = [k / bins for k in range(1, bins)]
    got = rows.select(F.posexplode("x").alias("pos", "v")).filter("NOT isnan(v)").groupBy("pos").agg(
        F.percentile_approx("v", shares, 10_000).alias("cuts")).collect()
    out = [np.empty(0)] * features
    for r in got:
        out[r["pos"]] = np.unique(np.array(r["cuts"], dtype=np.float64))
    return out


def _binned_rows(cuts):
    def run(batches):
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            bins = binned(flat.reshape(batch.num_rows, len(cuts)), cuts).tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("label", "weight", "is_val")),
                 pa.array([bins[k:k + len(cuts)] for k in range(0, len(bins), len(cuts))], pa.binary())],
                names=["label", "weight", "is_val", "bins"])
    return run


def _advanced(rounds: list[Round], classes: int):
    def run(batches):
        for batch in batches:
            *_, bins, margins = _columns(batch, classes)
            for r in rounds:
                r.add_to(margins, bins)
            offsets = pa.array(np.arange(len(bins) + 1, dtype=np.int32) * classes)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "label", "weight", "is_val", "bins")),
                 pa.ListArray.from_arrays(offsets, pa.array(margins.ravel()))], names=_STATE_NAMES)
    return run


_STATE_NAMES = ["row", "label", "weight", "is_val", "bins", "margins"]
_STATE = "row long, label int, weight double, is_val boolean, bins binary, margins array<double>"


def _written(df: DataFrame, base: str, name: str) -> DataFrame:
    path = os.path.join(base, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fit_boosting(rows: DataFrame, classes: int, params: BoostParams, features: int,
                 cuts: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], list[Round], list[dict]]:
    """(cuts, rounds, history) from rows of x (array of numbers), label (a class from 0),
    weight and is_val.

    Rows whose label is null or no class are not used; a null or NaN number lies below
    all others. ``history`` has the losses after each round, from 0; without validation
    rows all rounds are kept. Tables lie in the shared folder, so a lost executor costs
    the repetition of its tasks."""
    base = shared_path(rows.sparkSession, "boosting", uuid.uuid4().hex)
    use = rows.filter(F.col("label").between(0, classes - 1)).select(
        F.transform("x", lambda v: F.coalesce(v.cast("double"), F.lit(float("nan")))).alias("x"),
        F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"),
        F.coalesce("is_val", F.lit(False)).alias("is_val"))
    if cuts is None:
        cuts = quantile_cuts(use.filter("NOT is_val"), features, params.bins)
    state = _written(use.mapInArrow(_binned_rows(cuts), "label int, weight double, is_val boolean, bins binary")
                     .select(F.monotonically_increasing_id().alias("row"), "label", "weight", "is_val", "bins",
                             F.array().cast("array<double>").alias("margins")), base, "state=0")
    rounds: list[Round] = []
    history: list[dict] = []
    in_state, best = 0, 0
    for round_no in range(params.rounds + 1):
        last = round_no == params.rounds
        growing = Round.empty(classes, params.depth)
        got = _pass(state, rounds[in_state:], growing, 0, round_no, params, features, grow=not last)
        said = dict(zip(_LOSSES, [0] * len(_LOSSES)))
        for r in got:
            if r["class"] < 0:
                said[_LOSSES[r["feature"]]] = r["g"]
        history.append(_history_row(round_no, said))
        if said["validation_rows"]:
            if history[round_no]["validation_loss"] < history[best]["validation_loss"]:
                best = round_no
            if round_no - best >= params.patience:
                break
        else:
            best = round_no
        if last:
            break
        for level in range(params.depth):
            if level:
                got = _pass(state, rounds[in_state:], growing, level, round_no, params, features)
            if not grow_level(growing, got, level, round_no, features, params):
                break
        rounds.append(growing)
        if len(rounds) - in_state >= params.state_rounds:
            state = _written(state.mapInArrow(_advanced(rounds[in_state:], classes), _STATE),
                             base, f"state={len(rounds)}")
            in_state = len(rounds)
    return cuts, rounds[:best], history


def _history_row(round_no: int, said: dict) -> dict:
    out = {"round": round_no}
    for side in ("validation", "train"):
        n = said[f"{side}_rows"]
        out[f"{side}_rows"] = n
        out[f"{side}_loss"] = said[f"{side}_loss"] / UNIT / n if n else None
        out[f"{side}_error"] = said[f"{side}_wrong"] / n if n else None
    return out


# ------------------------------------------------------------ Spark ML stages

class SoftmaxBoost(Estimator):
    """Estimator over a vector column; ``is_val`` rows choose the round that is kept."""

    def __init__(self, featuresCol="latent", labelCol="label_idx", weightCol="weight",
                 validationIndicatorCol="is_val", classes: int = 0, **params):
        super().__init__()
        self.columns = (featuresCol, labelCol, weightCol, validationIndicatorCol)
        self.classes, self.boost = classes, BoostParams(**params)

    def _fit(self, df: DataFrame) -> "SoftmaxBoostModel":
        x, label, weight, is_val = self.columns
        first = df.select(F.size(vector_to_array(x)).alias("n")).first()
        width = first["n"] if first else 0
        classes = self.classes or (df.agg(F.max(label)).first()[0] or 0) + 1
        rows = df.select(vector_to_array(x).alias("x"), F.col(label).alias("label"),
                         F.col(weight).alias("weight"), F.col(is_val).alias("is_val"))
        cuts, rounds, history = fit_boosting(rows, classes, self.boost, width)
        return SoftmaxBoostModel(x, cuts, rounds, classes, self.boost, history)


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, self.sparkSession
        DefaultParamsWriter.saveMetadata(m, path, spark)     # a PipelineModel looks for it
        meta = {"features": m.featuresCol, "classes": m.classes, "params": asdict(m.boost),
                "cuts": [c.tolist() for c in m.cuts], "history": m.history}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
            .write.json(os.path.join(path, "meta"))
        trees = [(n, k, r.feature[k].tolist(), r.cut[k].tolist(), r.value[k].tolist(), r.gain[k].tolist())
                 for n, r in enumerate(m.rounds) for k in range(m.classes)]
        spark.createDataFrame(trees, "round int, class int, feature array<int>, cut array<int>, "
                                     "value array<double>, gain array<double>") \
            .coalesce(1).write.parquet(os.path.join(path, "trees"))


class _Reader(MLReader):
    def load(self, path: str) -> "SoftmaxBoostModel":
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.json(os.path.join(path, "meta")).first()["meta"])
        params = BoostParams(**meta["params"])
        found: dict = {}
        for r in spark.read.parquet(os.path.join(path, "trees")).collect():     # the model itself
            new = found.setdefault(r["round"], Round.empty(meta["classes"], params.depth))
            for name in ("feature", "cut", "value", "gain"):
                getattr(new, name)[r["class"]] = r[name]
        return SoftmaxBoostModel(meta["features"], [np.array(c, dtype=np.float64) for c in meta["cuts"]],
                                 [found[n] for n in sorted(found)], meta["classes"], params, meta["history"])


class SoftmaxBoostModel(Model, MLWritable, MLReadable):
    """Adds ``probability``, a vector of the classes' probabilities."""

    def __init__(self, featuresCol, cuts, rounds, classes, boost, history):
        super().__init__()
        self.featuresCol, self.cuts, self.rounds = featuresCol, cuts, rounds
        self.classes, self.boost, self.history = classes, boost, history

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        bins, margins = binned(x, self.cuts), np.zeros((len(x), self.classes))
        for r in self.rounds:
            r.add_to(margins, bins)
        return softmax(margins)

    def _transform(self, df: DataFrame) -> DataFrame:
        width, classes, score = len(self.cuts), self.classes, self.probabilities

        @F.arrow_udf("array<double>")
        def probs(x: pa.Array) -> pa.Array:
            flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            p = score(flat.reshape(len(x), width))
            return pa.ListArray.from_arrays(
                pa.array(np.arange(len(p) + 1, dtype=np.int32) * classes), pa.array(p.ravel()))
        return df.withColumn("probability", array_to_vector(probs(vector_to_array(self.featuresCol))))

    @property
    def featureImportances(self):
        """Gain by feature, as shares."""
        total = np.zeros(len(self.cuts))
        for r in self.rounds:
            cut = r.feature >= 0
            np.add.at(total, r.feature[cut], r.gain[cut])
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader()

"""A nonlinear encoder with its decoder, trained data-parallel.

The network is 256 - 128 - latent - 128 - 256 wide, leaky units throughout but for the
output, dropout behind the hidden layers. Training is synchronous: rows are dealt into
``steps`` slices of a written table; a step is one Spark job over a slice, in which every
task sums the gradient over its rows, tasks' sums are added up in chunks of the parameter
vector, and the driver takes one Adam step with the mean. Only parameters and their
gradients ever come to the driver. The validation loss is taken in an epoch's first job;
when it does not fall, the rate is halved, then training ends and the best parameters are
put back.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

LEAK = 0.1
CHUNK = 1 << 14              # parameters whose gradients travel in one row
TILE = 4096                  # rows that are multiplied together


@dataclass(frozen=True)
class EncoderParams:
    hidden: tuple = (256, 128)
    latent: int = 48
    epochs: int = 150
    steps: int = 4               # slices, so Adam steps, of an epoch
    rate: float = 0.001
    least_rate: float = 1e-6
    dropout: float = 0.25
    l1: float = 1e-5
    l2: float = 1e-4
    plateau: int = 10            # epochs without gain until the rate is halved
    patience: int = 20           # and until training ends
    seed: int = 42


# ---------------------------------------------------------------- the network

def layer_sizes(features: int, params: EncoderParams) -> list[tuple[int, int]]:
    wide = [features, *params.hidden, params.latent, *reversed(params.hidden), features]
    return list(zip(wide[:-1], wide[1:]))


def unpacked(theta: np.ndarray, sizes) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, bias) of each layer as views of the parameter vector."""
    out, at = [], 0
    for a, b in sizes:
        w = theta[at:at + a * b].reshape(a, b)
        out.append((w, theta[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def first_parameters(sizes, seed: int) -> np.ndarray:
    """Normal weights of variance 2 / inputs (He), biases of zero."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.concatenate((rng.normal(0, np.sqrt(2 / a), a * b), np.zeros(b)))
                           for a, b in sizes])


def _units(z: np.ndarray) -> np.ndarray:
    return np.where(z > 0, z, LEAK * z)


def encode(theta: np.ndarray, x: np.ndarray, sizes) -> np.ndarray:
    for w, b in unpacked(theta, sizes)[:len(sizes) // 2]:
        x = _units(x @ w + b)
    return x


def decode(theta: np.ndarray, latent: np.ndarray, sizes) -> np.ndarray:
    layers = unpacked(theta, sizes)[len(sizes) // 2:]
    for w, b in layers[:-1]:
        latent = _units(latent @ w + b)
    return latent @ layers[-1][0] + layers[-1][1]


def loss_and_gradient(theta: np.ndarray, x: np.ndarray, sizes, masks=None) -> tuple[float, np.ndarray]:
    """Sum over rows of the mean squared error, and its gradient. ``masks`` are factors
    of each layer's output, or None: dropout."""
    layers = unpacked(theta, sizes)
    inputs, sums, out = [], [], x
    for k, (w, b) in enumerate(layers):
        inputs.append(out)
        z = out @ w + b
        sums.append(z)
        out = z if k == len(layers) - 1 else _units(z)
        if masks is not None and masks[k] is not None:
            out = out * masks[k]
    apart = out - x
    loss = float((apart.astype(np.float64) ** 2).sum() / x.shape[1])
    back = 2 * apart / x.shape[1]
    grad = np.empty_like(theta)
    for k in range(len(layers) - 1, -1, -1):
        if k < len(layers) - 1:
            if masks is not None and masks[k] is not None:
                back = back * masks[k]
            back = back * np.where(sums[k] > 0, 1, LEAK).astype(back.dtype)
        gw, gb = unpacked(grad, sizes)[k]
        gw[:] = inputs[k].T @ back
        gb[:] = back.sum(axis=0)
        if k:
            back = back @ layers[k][0].T
    return loss, grad


def dropout_masks(rows: int, sizes, rate: float, seed: list[int]):
    """Factors of the hidden layers' outputs; the latent and the output layer have none."""
    if not rate:
        return None
    rng, middle, last = np.random.default_rng(seed), len(sizes) // 2 - 1, len(sizes) - 1
    return [None if k in (middle, last) else
            (rng.random((rows, b)) >= rate).astype(np.float32) / np.float32(1 - rate)
            for k, (_, b) in enumerate(sizes)]


class Adam:
    def __init__(self, size: int):
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0

    def step(self, theta: np.ndarray, grad: np.ndarray, rate: float) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad ** 2 - self.v)
        m, v = self.m / (1 - 0.9 ** self.t), self.v / (1 - 0.999 ** self.t)
        return theta - rate * m / (np.sqrt(v) + 1e-7)


# ------------------------------------------------------------------ training

def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return np.nan_to_num(x.reshape(len(column), width), nan=0.0, posinf=0.0, neginf=0.0)


def _task_gradient(theta: np.ndarray, sizes, params: EncoderParams, step: int):
    """Gradient, loss and rows of a task's training rows; loss and rows of its validation
    rows, which a first step also reads."""
    theta = theta.astype(np.float32)

    def run(batches):
        grad, said = np.zeros(len(theta)), np.zeros(4)
        part = TaskContext.get().partitionId()
        n_tile = 0
        for batch in batches:
            all_x = _matrix(batch.column("x"), sizes[0][0], np.float32)
            held = batch.column("slice").to_numpy() < 0
            held_x = all_x[held]
            for at in range(0, len(held_x), TILE):
                x = held_x[at:at + TILE]
                apart = decode(theta, encode(theta, x, sizes), sizes) - x
                said[2:] += (apart.astype(np.float64) ** 2).sum() / x.shape[1], len(x)
            x = all_x[~held]
            for at in range(0, len(x), TILE):
                some = x[at:at + TILE]
                masks = dropout_masks(len(some), sizes, params.dropout, [params.seed, step, part, n_tile])
                loss, g = loss_and_gradient(theta, some, sizes, masks)
                grad += g
                said[:2] += loss, len(some)
                n_tile += 1
        both = np.concatenate((said, grad if said[1] else ()))
        chunks = [both[at:at + CHUNK] for at in range(0, len(both), CHUNK)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(chunks)), pa.int32()), pa.array([part] * len(chunks), pa.int32()),
             pa.array([c.tobytes() for c in chunks], pa.binary())], names=["chunk", "part", "sums"])
    return run


def _added(batches):
    """Chunks of a partition that has all of each chunk, sorted by chunk and task, added up
    in the order of tasks; one chunk is held at a time."""
    def row(chunk, total):
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                          names=["chunk", "sums"])
    mine, total = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            chunk = batch.column("chunk")[k].as_py()
            p = np.frombuffer(batch.column("sums")[k].as_buffer())
            if chunk != mine:
                if mine is not None:
                    yield row(mine, total)
                mine, total = chunk, np.zeros(0)
            if len(p) > len(total):         # a task without training rows has no gradient
                total = np.concatenate((total, np.zeros(len(p) - len(total))))
            total[:len(p)] += p
    if mine is not None:
        yield row(mine, total)


def _step(rows: DataFrame, theta, sizes, params, step) -> tuple[np.ndarray, np.ndarray]:
    """(losses and rows, summed gradient) of one job."""
    got = rows.mapInArrow(_task_gradient(theta, sizes, params, step), "chunk int, part int, sums binary") \
        .repartition("chunk").sortWithinPartitions("chunk", "part") \
        .mapInArrow(_added, "chunk int, sums binary").collect()
    parts = [np.frombuffer(bytes(r["sums"])) for r in sorted(got, key=lambda r: r["chunk"])]
    both = np.concatenate(parts) if parts else np.zeros(4)
    return both[:4], both[4:]


def train(rows: DataFrame, features: int, params: EncoderParams) -> tuple[np.ndarray, list[dict]]:
    """(parameters, history) from rows of x (an array of ``features`` numbers) and is_val.

    What is no number counts as 0. Without validation rows the training loss decides.
    ``history`` has the losses before each epoch's first step. No training rows: the
    first parameters. Slices lie in the shared folder, so a lost executor costs the
    repetition of its tasks."""
    sizes = layer_sizes(features, params)
    theta = first_parameters(sizes, params.seed)
    base = shared_path(rows.sparkSession, "encoder", uuid.uuid4().hex)
    x = F.transform("x", lambda v: F.coalesce(v.cast("float"), F.lit(0.0).cast("float")))
    rows.select(x.alias("x"), F.when(F.coalesce("is_val", F.lit(False)), -1).otherwise(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(params.steps))).cast("int").alias("slice")) \
        .write.partitionBy("slice").parquet(base)
    table = rows.sparkSession.read.schema("x array<float>, slice int").parquet(base)
    slices = sorted(r["slice"] for r in table.filter("slice >= 0").select("slice").distinct().collect())
    adam, rate, history = Adam(len(theta)), params.rate, []
    if not slices:
        return theta, history
    best, best_theta, since, flat = np.inf, theta, 0, 0
    weights = np.concatenate([np.concatenate((np.ones(a * b), np.zeros(b))) for a, b in sizes])
    for epoch in range(params.epochs + 1):
        for s in slices:
            part = table.filter(F.col("slice").isin([s, -1]) if s == slices[0] else F.col("slice") == s)
            (loss, n, held_loss, held_n), grad = _step(part, theta, sizes, params, epoch * params.steps + s)
            if s == slices[0]:
                now = held_loss / held_n if held_n else loss / n
                history.append({"epoch": epoch, "rate": rate, "train_loss": loss / n,
                                "validation_loss": held_loss / held_n if held_n else None})
                if now < best:
                    best, best_theta, since, flat = now, theta, 0, 0
                else:
                    since, flat = since + 1, flat + 1
                if since >= params.patience or epoch == params.epochs:
                    return best_theta, history
                if flat >= params.plateau:
                    rate, flat = max(rate / 2, params.least_rate), 0
            grad = grad / n + weights * (params.l1 * np.sign(theta) + 2 * params.l2 * theta)
            theta = adam.step(theta, grad, rate)
    return best_theta, history


# ------------------------------------------------------------- Spark ML stages

class NeuralEncoder(Estimator):
    """Estimator over a vector column; rows with ``is_val`` choose the epoch kept."""

    def __init__(self, inputCol="fvec", outputCol="latent", validationIndicatorCol="is_val", **params):
        super().__init__()
        self.columns, self.network = (inputCol, outputCol, validationIndicatorCol), EncoderParams(**params)

    def _fit(self, df: DataFrame) -> "NeuralEncoderModel":
        source, out, is_val = self.columns
        first = df.select(F.size(vector_to_array(source)).alias("n")).first()
        features = first["n"] if first else 1
        held = F.col(is_val) if is_val in df.columns else F.lit(False)
        theta, history = train(df.select(vector_to_array(source).alias("x"), held.alias("is_val")),
                               features, self.network)
        return NeuralEncoderModel(source, out, features, self.network, theta, history)


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession)     # a PipelineModel looks for it
        meta = {"columns": m.columns, "features": m.features, "params": asdict(m.network), "history": m.history}
        chunks = [(k, bytearray(m.theta[at:at + CHUNK].tobytes()))
                  for k, at in enumerate(range(0, len(m.theta), CHUNK))]
        self.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
            .write.json(os.path.join(path, "meta"))
        self.sparkSession.createDataFrame(chunks, "chunk int, numbers binary").coalesce(1) \
            .write.parquet(os.path.join(path, "parameters"))


class _Reader(MLReader):
    def load(self, path: str) -> "NeuralEncoderModel":
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.json(os.path.join(path, "meta")).first()["meta"])
        rows = spark.read.parquet(os.path.join(path, "parameters")).collect()
        theta = np.concatenate([np.frombuffer(bytes(r["numbers"])) for r in sorted(rows, key=lambda r: r["chunk"])])
        network = meta["params"] | {"hidden": tuple(meta["params"]["hidden"])}
        return NeuralEncoderModel(*meta["columns"], meta["features"], EncoderParams(**network), theta,
                                  meta["history"])


class NeuralEncoderModel(Model, MLWritable, MLReadable):
    """Adds the encoding of a vector column."""

    def __init__(self, inputCol, outputCol, features, network, theta, history):
        super().__init__()
        self.columns, self.features, self.network = [inputCol, outputCol], features, network
        self.theta, self.history = theta, history

    def _mapped(self, column, run):
        """An array column through the network, in single precision."""
        theta, sizes = self.theta.astype(np.float32), layer_sizes(self.features, self.network)

        @F.arrow_udf("array<double>")
        def apply(x: pa.Array) -> pa.Array:
            width = sizes[0][0] if run is encode else sizes[len(sizes) // 2][0]
            end = sizes[len(sizes) // 2 - 1 if run is encode else -1][1]
            out = np.empty((len(x), end))
            for at in range(0, len(x), TILE):         # layers are wider than what comes out
                out[at:at + TILE] = run(theta, _matrix(x.slice(at, TILE), width, np.float32), sizes)
            return pa.ListArray.from_arrays(
                pa.array(np.arange(len(out) + 1, dtype=np.int32) * end), pa.array(out.ravel()))
        return apply(column)

    def _transform(self, df: DataFrame) -> DataFrame:
        source, out = self.columns
        return df.withColumn(out, array_to_vector(self._mapped(vector_to_array(source), encode)))

    def decoded(self, latent):
        """The reconstruction of an array column of encodings."""
        return self._mapped(latent, decode)

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader()

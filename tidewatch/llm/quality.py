"""Quality classification by co-training two views (operator 1).

The text view is a logistic model over what a text is made of (hashed byte
trigrams, ASCII character shares, shape figures); the metadata view one over its
source, language and length. Both start from the labelled rows. In each round
either scores every unlabelled row and hands those it is surest of, as
pseudo-labels, to the *other* view's training rows. A view's sureness is its
probability after calibration (Platt) on labelled rows kept aside. A document's score
adds the two views' calibrated log odds, less the prior's, which counts once.

On Spark: the features of all documents are written once, and a round is a few passes
over them. One counts the free rows by view, label and probability, which gives the cuts
(a row at a cut is taken by a hash of its key, so ties cannot swell a gift). Then come
steps of Newton's kind: tasks sum gradient and curvature over the rows handed so far, and
the driver, which holds nothing else of them, solves for the weights. What was handed follows
from the rounds' weights and cuts, so no row carries a state. The pseudo-labels of a view
weigh as much as its labelled rows at most, so a larger corpus sharpens them without
drowning those.

The labelled rows are a sample of about ``LABELLED`` in expectation, by a hash of the id:
a documented bound. Their features alone come to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import document_batches, table, written

LABELLED = 4000
ROUNDS = 4
STEPS = 2                 # steps of a round
BINS = 1 << 12            # of a probability, where cuts can lie
SURE = 0.95               # a pseudo-label's probability, at least
SHARE = 0.05              # of all unlabelled rows that one view hands over in a round, at most
RIDGE = 1e-3
THRESHOLD = 0.5
GRAMS, CHARS, SHAPE = 512, 128, 8
SOURCES, LANGS, SIZES = 64, 16, 24
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def text_features(text: str | None) -> np.ndarray:
    """The text view: square roots of shares, and shape. Null: as empty, all zero."""
    out = np.zeros(GRAMS + CHARS + SHAPE, dtype=np.float32)
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return out
    b = np.frombuffer(data, dtype=np.uint8)
    if len(b) > 2:
        w = b.astype(np.uint32)
        grams = ((w[:-2] | (w[1:-1] << np.uint32(8)) | (w[2:] << np.uint32(16)))
                 * np.uint32(2654435761)) >> np.uint32(23)
        out[:GRAMS] = np.sqrt(np.bincount(grams, minlength=GRAMS) / len(grams))
    chars = np.bincount(b, minlength=256)
    out[GRAMS:GRAMS + CHARS] = np.sqrt(chars[:CHARS] / len(b))
    words, lines = data.split(), data.split(b"\n")
    out[GRAMS + CHARS:] = (
        np.log1p(len(b)) / 10, np.log1p(len(words)) / 10, len(b) / (len(words) + 1) / 20,
        chars[_LETTERS].sum() / len(b), len(set(words)) / (len(words) + 1),
        len(set(lines)) / len(lines), np.log1p(len(lines)) / 5,
        len(max(words, key=len, default=b"")) / (len(data) + 1))
    return out


def meta_features(source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> np.ndarray:
    """The metadata view: one-hot hashed source and language, and size class; a
    null has none of its group."""
    out = np.zeros((len(source), SOURCES + LANGS + SIZES), dtype=np.float32)
    for values, size, first in ((source, SOURCES, 0), (lang, LANGS, SOURCES)):
        known = values.notna().to_numpy()
        slot = pd.util.hash_array(values[known].astype(str).to_numpy(dtype=object)) % size
        out[np.flatnonzero(known), first + slot.astype(np.int64)] = 1
    size = pd.to_numeric(n_chars, errors="coerce").to_numpy(dtype=np.float64)
    known = np.flatnonzero(size >= 0)
    slot = np.minimum(np.log2(size[known] + 1) * 1.2, SIZES - 1).astype(np.int64)
    out[known, SOURCES + LANGS + slot] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 200):
    """(weights, bias) of a ridge logistic model by accelerated gradient steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + np.float32(0.02)
    z = (x - mean) / scale
    n = len(z)
    w, b = np.zeros(z.shape[1], np.float32), np.float32(0)
    look, look_b = w, b
    pace = np.float32(4 / (1 + (z ** 2).sum(axis=1).mean() / 4))
    for t in range(1, steps + 1):
        wrong = (1 / (1 + np.exp(-(z @ look + look_b))) - y).astype(np.float32)
        new, new_b = look - pace * (z.T @ wrong / n + ridge * look), look_b - pace * wrong.mean()
        push = np.float32((t - 1) / (t + 2))
        look, look_b = new + push * (new - w), new_b + push * (new_b - b)
        w, b = new, new_b
    return w / scale, float(b - (w * mean / scale).sum())


def _odds(x, model):
    return x @ model[0] + model[1]


def _probability(odds):
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Round:
    """What a round's gifts follow from: the views' models, their calibration, and the cuts
    by (view, label): (bin, share of the rows in that bin), or None for no gift."""

    def __init__(self, models, scales):
        self.models, self.scales, self.cuts = models, scales, {}

    def bins(self, xs) -> list[list[np.ndarray]]:
        """By view and label (0, 1): the bin of each row's calibrated probability."""
        out = []
        for x, model, (slope, bias) in zip(xs, self.models, self.scales):
            p = _probability((slope * _odds(x, model) + bias).astype(np.float64))
            out.append([np.minimum(((1 - p) * BINS).astype(np.int64), BINS - 1),
                        np.minimum((p * BINS).astype(np.int64), BINS - 1)])
        return out


def _gifts(xs, key: np.ndarray, rounds: list[Round]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(which rows are free after ``rounds``, by view the label it gave each row or -1)."""
    luck = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)) / float(1 << 53)
    free = np.ones(len(key), dtype=bool)
    given = [np.full(len(key), -1, dtype=np.int64) for _ in range(2)]
    for r in rounds:
        now = free.copy()
        for v, by_label in enumerate(r.bins(xs)):
            for label, b in enumerate(by_label):
                if r.cuts.get((v, label)) is not None:
                    cut, share = r.cuts[v, label]
                    take = now & ((b > cut) | (b == cut) & (luck < share))
                    given[v][take] = label
                    free[take] = False
    return free, given


def count_bins(xs, key, rounds: list[Round]) -> np.ndarray:
    """(view, label, bin): the free rows, by their probability in the last of ``rounds``."""
    free, _ = _gifts(xs, key, rounds[:-1])
    out = np.zeros((2, 2, BINS), dtype=np.int64)
    for v, by_label in enumerate(rounds[-1].bins([x[free] for x in xs])):
        for label, b in enumerate(by_label):
            out[v, label] = np.bincount(b, minlength=BINS)
    return out


def step_sums(x: np.ndarray, y: np.ndarray, model) -> np.ndarray:
    """Rows, gradient and curvature of the logistic loss, end to end. The curvature is that
    of the tightest parabola above the loss that touches it at the model's odds, so a step
    to its foot never raises the loss, however sure the model is."""
    wide = np.concatenate((x, np.ones((len(x), 1), x.dtype)), axis=1).astype(np.float64)
    z = np.clip(_odds(x, model).astype(np.float64), -30, 30)
    bend = np.where(np.abs(z) < 1e-6, 0.25, np.tanh(z / 2) / (2 * np.where(z == 0, 1, z)))
    return np.concatenate(([len(x)], wide.T @ (_probability(z) - y), ((wide * bend[:, None]).T @ wide).ravel()))


def gift_sums(xs, key, rounds: list[Round], models) -> np.ndarray:
    """``step_sums`` of the rows that each view was handed, the first view's first."""
    _, given = _gifts(xs, key, rounds)
    out = []
    for v, x in enumerate(xs):
        mine = given[1 - v] >= 0
        out.append(step_sums(x[mine], given[1 - v][mine], models[v]))
    return np.concatenate(out)


class LocalRows:
    """Unlabelled rows in memory: both views' features, and a key each."""

    def __init__(self, xs, key):
        self.xs, self.key = xs, key

    def total(self, run) -> np.ndarray:
        return run(self.xs, self.key)


class SparkRows:
    """Unlabelled rows as a written table of (key, text, meta), ``VIEWS`` features."""

    def __init__(self, df: DataFrame):
        self.df = df.select("key", "text", "meta")

    def total(self, run) -> np.ndarray:
        """The sum of ``run`` over all rows: per task, then in chunks of its numbers."""
        def one(batches):
            part, out = TaskContext.get().partitionId(), None
            for batch in batches:
                got = run(_matrices(batch.column("text").to_pylist(), batch.column("meta").to_pylist()),
                          batch.column("key").to_numpy())
                out = got if out is None else out + got
            if out is not None:
                flat = out.astype(np.float64).ravel()
                chunks = [flat[at:at + CHUNK].tobytes() for at in range(0, len(flat), CHUNK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(chunks)), pa.int32()), pa.array([part] * len(chunks), pa.int32()),
                     pa.array(chunks, pa.binary())], names=["chunk", "part", "sums"])

        def added(batches):
            found: dict = {}
            for batch in batches:
                for chunk, part, sums in zip(*(c.to_pylist() for c in batch.columns)):
                    found.setdefault(chunk, {})[part] = sums
            for chunk, sums in found.items():      # in the order of tasks: the same sum each time
                total = sum(np.frombuffer(s) for _, s in sorted(sums.items()))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                                 names=["chunk", "sums"])
        got = self.df.mapInArrow(one, "chunk int, part int, sums binary").repartition("chunk") \
            .mapInArrow(added, "chunk int, sums binary").collect()
        shape = run([np.zeros((0, GRAMS + CHARS + SHAPE), np.float32),
                     np.zeros((0, SOURCES + LANGS + SIZES), np.float32)], np.zeros(0, np.int64))
        if not got:
            return shape
        flat = np.concatenate([np.frombuffer(bytes(r["sums"])) for r in sorted(got, key=lambda r: r["chunk"])])
        return flat.reshape(shape.shape)


CHUNK = 1 << 14


def _matrices(text: list[bytes], meta: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(c), dtype="<f2").reshape(len(c), -1).astype(np.float32) if c
            else np.zeros((0, width), np.float32)
            for c, width in ((text, GRAMS + CHARS + SHAPE), (meta, SOURCES + LANGS + SIZES))]


def cut_of(counts: np.ndarray, most: int, sure: float = SURE) -> tuple[int, float] | None:
    """The cut that takes the ``most`` likeliest rows of at least ``sure``, or all there are."""
    least = int(np.ceil(sure * BINS))
    above = 0
    for b in range(BINS - 1, least - 1, -1):
        n = int(counts[b])
        if above + n >= most:
            return b, (most - above) / n
        above += n
    return (least, 1.0) if above else None


def co_train(views: list[np.ndarray], y: np.ndarray, pool, aside: np.ndarray,
             rounds: int = ROUNDS, sure: float = SURE, share: float = SHARE, steps: int = STEPS) -> dict:
    """Fit both views on the labelled rows that are not ``aside`` and on each
    other's pseudo-labels over ``pool`` (``LocalRows`` or ``SparkRows``); calibrate on
    those that are."""
    own = [(v[~aside], y[~aside]) for v in views]
    scale2 = [np.append((x.std(axis=0) + np.float32(0.02)).astype(np.float64) ** 2, 0) for x, _ in own]

    def calibrated(models):
        scales = []
        for v, model in zip(views, models):
            slope, bias = logistic(_odds(v[aside], model)[:, None].astype(np.float32), y[aside])
            scales.append((float(slope[0]), bias))
        return Round(models, scales)

    past, now = [], calibrated([logistic(x, t) for x, t in own])
    handed, limit = [0, 0], None
    for _ in range(rounds):
        counts = pool.total(lambda xs, key, r=[*past, now]: count_bins(xs, key, r))
        if limit is None:
            limit = share * counts[0, 0].sum()
        for v in (0, 1):
            for label in (1, 0):      # as many of a class as it has among the labels
                most = max(1, round(limit * float((y == label).mean())))
                now.cuts[v, label] = cut_of(counts[v, label], most, sure)
        if all(c is None for c in now.cuts.values()):
            break
        past.append(now)
        models = now.models
        for _ in range(steps):
            sums = pool.total(lambda xs, key, r=list(past), m=models: gift_sums(xs, key, r, m))
            new, at = [], 0
            for v, (x, t) in enumerate(own):
                d = x.shape[1] + 1
                gift, at = sums[at:at + 1 + d + d * d], at + 1 + d + d * d
                handed[1 - v] = int(gift[0])
                mine = step_sums(x, t, models[v])
                mine += gift * min(1.0, len(x) / max(1.0, gift[0]))
                w = np.append(models[v][0], models[v][1]).astype(np.float64)
                slope = mine[1:1 + d] / mine[0] + RIDGE * scale2[v] * w
                bend = mine[1 + d:].reshape(d, d) / mine[0] + np.diag(RIDGE * scale2[v] + 1e-9)
                w = w - np.linalg.solve(bend, slope)
                new.append((w[:-1].astype(np.float32), float(w[-1])))
            models = new
        now = calibrated(models)
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    return {"models": now.models, "scales": now.scales, "prior": float(np.log(rate / (1 - rate))),
            "handed": handed}


def _view_columns(docs, text_col, source_col, lang_col, size_col):
    return [F.col(text_col).cast("string"), F.col(source_col).cast("string"),
            F.col(lang_col).cast("string"), F.col(size_col).cast("double")]


# Half-precision vectors as bytes.
VIEWS = T.StructType([T.StructField("text", T.BinaryType()), T.StructField("meta", T.BinaryType())])


@F.pandas_udf(VIEWS)
def _views(text, source, lang, size):
    return pd.DataFrame({"text": [text_features(t).astype("<f2").tobytes() for t in text],
                         "meta": [m.astype("<f2").tobytes()
                                  for m in meta_features(source, lang, size)]})


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars") -> DataFrame:
    """(id, key, text, meta) of every row, written: both views' features, and a hash of
    id and text."""
    document_batches(docs.sparkSession)
    views = _view_columns(docs, text_col, source_col, lang_col, size_col)
    return written(docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("key"),
                               _views(*views).alias("v")).select("id", "key", "v.*"), "features")


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED,
        id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text",
        source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars",
        features: DataFrame | None = None) -> dict | None:
    """The co-trained model, or None where the labels hold fewer than two classes
    or too few rows. ``features`` are those of ``docs``, where they are there already.

    An id whose labels differ is left out. Repeats of a labelled row count once, those of
    an unlabelled one as often as they come; a row with a null id is unlabelled. A null
    text is an empty one, a null of the metadata none of its kind; long texts are read
    whole. An empty table has no labelled rows. Other columns are not read."""
    cells = 1 << 30
    truth = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()) \
        .groupBy(id_col).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")) \
        .filter("y = z").select(F.col(id_col).alias("id"), F.col("y").cast("int").alias("y"))
    truth = written(truth, "labels")
    known = written(truth.filter(F.pmod(F.xxhash64(F.lit("labelled"), "id"), F.lit(cells)) < min(
        cells, labelled * cells // max(1, truth.count()) + 1)), "labelled")   # bounded
    if features is None:
        features = featured(docs, id_col, text_col, source_col, lang_col, size_col)
    data = features.join(F.broadcast(known), "id").dropDuplicates(["key"]) \
        .select("key", "y", "text", "meta").toPandas().sort_values("key", kind="stable")
    y = data["y"].to_numpy()
    if (y == 0).sum() < 5 or (y == 1).sum() < 5:
        return None
    aside = data["key"].to_numpy() % 4 == 0
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        return None
    rest = features.join(F.broadcast(known.select("id")), "id", "left_anti")
    return co_train(_matrices(list(data["text"]), list(data["meta"])), y.astype(np.float32),
                    SparkRows(rest), aside)


SCORES = T.StructType([T.StructField(n, T.DoubleType())
                       for n in ("text_score", "meta_score", "score")])


def _rated(model):
    """Scores of both views' features."""
    def rate(xs) -> pd.DataFrame:
        if model is None:
            return pd.DataFrame(np.nan, index=range(len(xs[0])), columns=SCORES.names).astype(object) \
                .where(lambda d: d.notna(), None)
        odds = [slope * _odds(x, m).astype(np.float64) + bias
                for x, m, (slope, bias) in zip(xs, model["models"], model["scales"])]
        both = odds[0] + odds[1] - model["prior"]
        return pd.DataFrame({n: _probability(o) for n, o in zip(SCORES.names, (*odds, both))})
    return rate


def _kept(rows: DataFrame, scores, threshold: float) -> DataFrame:
    return rows.select("doc_id", scores.alias("s")).select(
        "doc_id", "s.*", F.coalesce(F.col("s.score") >= threshold, F.lit(True)).alias("keep"))


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars",
          threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) for every row of ``docs``:
    each view's calibrated probability, the combined one, and whether it reaches
    ``threshold``. Nulls in any column are scored as described for the features; a text
    is read whole. Rows that repeat get equal scores; an empty table gives no rows. Other
    columns are not read. Without a model every score is null and every row is kept."""
    document_batches(docs.sparkSession)
    rated = _rated(model)

    @F.pandas_udf(SCORES)
    def rate(text, source, lang, size):
        half = np.array([text_features(t) for t in text]).reshape(len(text), -1).astype(np.float16)
        return rated([half.astype(np.float32), meta_features(source, lang, size)])

    views = _view_columns(docs, text_col, source_col, lang_col, size_col)
    return _kept(docs.select(F.col(id_col).alias("doc_id"), *[v.alias(f"v{k}") for k, v in enumerate(views)]),
                 rate(*[F.col(f"v{k}") for k in range(4)]), threshold)


def score_features(features: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """``score`` of the rows of ``featured``."""
    rated = _rated(model)

    @F.pandas_udf(SCORES)
    def rate(text, meta):
        return rated(_matrices(list(text), list(meta)))
    return _kept(features.withColumnRenamed("id", "doc_id"), rate("text", "meta"), threshold)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    features = featured(docs)
    return score_features(features, fit(docs, table(spark, sf_dir, "labels"), features=features))


QUERIES = {"op1_quality_cotraining": query}

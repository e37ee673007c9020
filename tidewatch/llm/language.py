"""Language identification by hierarchical discrimination (operator 10).

First one-versus-one linear SVMs over the language families in the training rows,
then, inside the chosen family, one-versus-one linear SVMs between its languages.
Features are hashed byte trigrams of the text, A-Z lower-cased and every other
ASCII character that is no letter folded to a space, as a vector of counts of
length one; only the text is read.

Training rows are a sample of ``sample_rows`` of each language in expectation,
chosen by a hash of the id, so a language with a third of all rows costs no more.
Each sampled row goes to the pairs it belongs to, and each pair is fitted by one
task (dual coordinate descent); the driver receives ``DIM`` weights a pair.
Prediction is one pass over the texts.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import document_batches, fresh, id_crc_mod, table

DIM = 1 << 13
MAX_LANGUAGES = 1000    # more values than this are no languages
SAMPLE_ROWS = 1500      # training rows of each language, in expectation
HELD_OUT = (5, 0)       # crc32(id as text) mod 5 == 0 is never learned from
UNKNOWN = "und"
# Families of closely related languages; a language that is not listed is its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "is", "lb", "fy"),
    "romance": ("fr", "es", "pt", "it", "ca", "ro", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "ne", "pa", "gu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tt"),
}
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32
              for b in range(256))


def _slots(data: bytes) -> np.ndarray:
    """Hash slot of each byte trigram of folded text."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    g = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    return (g * np.uint32(2654435761)) >> np.uint32(32 - DIM.bit_length() + 1)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _folded(text: str) -> bytes:
    words = text.encode("utf-8", "replace").translate(_FOLD).split()
    return b" " + b" ".join(words) + b" "


def _counts(text: str) -> np.ndarray:
    """Trigram counts, scaled to a vector of length one."""
    n = np.bincount(_slots(_folded(text)), minlength=DIM).astype(np.float32)
    return n / np.sqrt(n @ n)


FEATURES = T.StructType([T.StructField("slots", T.ArrayType(T.IntegerType())),
                         T.StructField("values", T.ArrayType(T.FloatType()))])


@F.udf(FEATURES)
def _features(text):
    if not has_letter(text):
        return None
    row = _counts(text)
    at = np.flatnonzero(row)
    return at.tolist(), row[at].tolist()


def svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float = 4.0,
        epochs: int = 8, seed: int = 0) -> np.ndarray:
    """Weights and a bias of a linear SVM with hinge loss over sparse rows of
    length one, by dual coordinate descent in a seeded order."""
    w = np.zeros(DIM + 1, dtype=np.float64)     # the last weight is the bias
    alpha = np.zeros(len(rows))
    order = np.arange(len(rows))
    shuffle = np.random.default_rng(seed).shuffle
    for _ in range(epochs):
        shuffle(order)
        for k in order:
            at, x = rows[k]
            slope = signs[k] * (w[at] @ x + w[DIM]) - 1
            new = min(max(alpha[k] - slope / 2, 0.0), cost)     # |x|^2 + 1 is 2
            if new != alpha[k]:
                w[at] += (new - alpha[k]) * signs[k] * x
                w[DIM] += (new - alpha[k]) * signs[k]
                alpha[k] = new
    return w


def _fit_pair(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id_hash", kind="stable")      # the order rows arrive in varies
    rows = [(np.asarray(s, dtype=np.int64), np.asarray(v, dtype=np.float64))
            for s, v in zip(pdf["slots"], pdf["values"])]
    return pd.DataFrame({"pair": pdf["pair"].head(1), "weights": [svm(rows, pdf["sign"].to_numpy())]})


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), f"={lang}")


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model: ``{"families": {family: [lang]}, "pairs": {(a, b): weights}}``,
    pairs over families and over each family's languages. Rows with a null
    language or id, or without a letter, are not learned from; no such rows: an
    empty model. The classes are taken to be few (languages), not the rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.col(lang_col).alias("lang"))
    mod, held = HELD_OUT
    learn = rows.filter(F.col("lang").isNotNull() & (id_crc_mod("id", mod) != held))
    # one row a language
    counts = {r["lang"]: r["n"] for r in
              learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
              .limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values")
    if not counts:
        return {"families": {}, "pairs": {}}
    cells = 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items())
                           for x in (lang, min(cells, sample_rows * cells // n + 1))])
    drawn = learn.filter(F.pmod(F.xxhash64(F.lit("lang"), "id"), F.lit(cells))
                         < F.element_at(share, F.col("lang")))
    families: dict[str, list[str]] = {}
    for lang in sorted(counts):
        families.setdefault(family_of(lang), []).append(lang)
    # (pair, languages for, languages against): families first, then inside each
    pairs = [((f, g), families[f], families[g]) for f, g in combinations(sorted(families), 2)]
    pairs += [((a, b), [a], [b]) for members in families.values()
              for a, b in combinations(members, 2)]
    if not pairs:
        return {"families": families, "pairs": {}}
    roles = {lang: [(k, 1 if lang in first else -1) for k, (_, first, second) in enumerate(pairs)
                    if lang in first + second] for lang in counts}
    roles_of = F.create_map(*[x for lang, rs in sorted(roles.items()) for x in (
        F.lit(lang), F.array(*[F.struct(F.lit(k).alias("pair"), F.lit(s).alias("sign"))
                               for k, s in rs]))])
    # a row that repeats counts once, so a sample stays bounded whatever is copied
    drawn = drawn.withColumn("id_hash", F.xxhash64("id", "text")).dropDuplicates(["id_hash"])
    rows = drawn.select("lang", "id_hash", _features("text").alias("f")).filter("f IS NOT NULL") \
        .select("id_hash", "f.*", F.explode(F.element_at(roles_of, F.col("lang"))).alias("r"))
    fitted = rows.select("id_hash", "slots", "values", "r.*").groupBy("pair").applyInPandas(
        _fit_pair, "pair int, weights array<double>").collect()
    # a pair of which no row was drawn says nothing
    weights = dict.fromkeys((p for p, _, _ in pairs), np.zeros(DIM + 1, dtype=np.float32))
    weights |= {pairs[r["pair"]][0]: np.asarray(r["weights"], dtype=np.float32) for r in fitted}
    return {"families": families, "pairs": weights}


def _vote(names: list[str], margin: dict) -> tuple[str, float]:
    """The winner of the one-versus-one votes (ties: larger summed margin, then
    name) and its logistic score against its closest rival."""
    if len(names) == 1:
        return names[0], 1.0
    votes, total = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
    for a, b in combinations(names, 2):
        m = margin[a, b]
        votes[a if m >= 0 else b] += 1
        total[a] += m
        total[b] -= m
    best = min(names, key=lambda x: (-votes[x], -total[x], x))
    close = min(margin[best, x] if (best, x) in margin else -margin[x, best]
                for x in names if x != best)
    return best, float(1 / (1 + np.exp(-np.clip(3 * close, -30, 30))))


def predictor(model: dict):
    """A function from a list of texts to [(language, score)]."""
    pairs = list(model["pairs"])
    families = model["families"]
    weights = np.array([model["pairs"][p][:DIM] for p in pairs], dtype=np.float32)
    bias = np.array([model["pairs"][p][DIM] for p in pairs], dtype=np.float32)
    order = sorted(families)

    def one(text):
        if not order or not has_letter(text):
            return UNKNOWN, 0.0
        margin = dict(zip(pairs, (weights @ _counts(text) + bias).tolist())) if pairs else {}
        family, sure = _vote(order, margin)
        lang, score = _vote(families[family], margin)
        return lang, sure * score

    return lambda texts: [one(t) for t in texts]


def predict(docs: DataFrame, model: dict, text_col: str = "text",
            lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with two columns more: the language (``und`` for a null text or
    one without any letter, or when nothing was learned) and a score in 0 to 1.

    Columns of these two names are replaced, all others carried along. Every row is
    judged by its text alone, so repeated rows get equal answers; a text is read whole,
    however long, with memory that follows the longest one. An empty table gives none."""
    document_batches(docs.sparkSession)
    kind = T.StructType([T.StructField("lang", T.StringType()),
                         T.StructField("score", T.DoubleType())])

    @F.pandas_udf(kind)
    def label(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(predictor(model)(texts), columns=["lang", "score"])

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (lang_out, score_out)]
    (both,) = fresh(docs, "said")
    said = docs.select(*rest, label(F.col(text_col)).alias(both))
    return said.select(*rest, F.col(f"{both}.lang").alias(lang_out),
                       F.col(f"{both}.score").alias(score_out))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    mod, held = HELD_OUT
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(id_crc_mod("doc_id", mod) == held, F.lit(True)).alias("held_out"),
        "lang_pred", "score")


QUERIES = {"op10_language_id": query}

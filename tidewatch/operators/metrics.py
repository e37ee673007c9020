"""Evaluation tables.

All are aggregations with map-side partial aggregation: the shuffle carries
one row per (task, group), never per input row. Array columns (probability
rows, encodings) are aggregated by position in one pass; what is left is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import argmax_index


def matrix_preview(df: DataFrame, array: str, order: str, rows: int = 5, columns: int = 5) -> DataFrame:
    """The corner of a matrix whose rows are arrays (O6): ``order``, position and value of
    the first ``columns`` positions of the first ``rows`` rows."""
    return df.select(order, F.slice(array, 1, columns).alias("_a")).orderBy(order).limit(rows) \
        .select(order, F.posexplode("_a").alias("position", "value"))


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Share of rows where prediction equals truth."""
    return df.agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"),
                  F.count(F.lit(1)).alias("rows"))


def validation_gate(df: DataFrame, truth: str, pred: str, target: float = 0.90) -> DataFrame:
    """Accuracy compared with the 90% target."""
    return accuracy(df, truth, pred).withColumn("meets_target", F.col("accuracy") >= target)


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(truth, predicted, count) for every observed pair."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("count"))


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per-class precision, recall, f1, support, then ``accuracy``,
    ``macro avg`` and ``weighted avg`` rows (A20). A zero denominator gives 0.
    Class keys are cast to text so summary rows share the column.

    One confusion table (one scan) gives everything: its rows, as many as pairs of
    classes, meet in one row whose array the figures are computed on."""
    t, p = F.col(truth).cast("string"), F.col(pred).cast("string")
    pairs = df.groupBy(t.alias("t"), p.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.expr("""array(
        struct(t AS cls, n AS support, IF(t <=> p, n, 0L) AS tp, 0L AS predicted),
        struct(p AS cls, 0L AS support, 0L AS tp, n AS predicted))""")).alias("s")).select("s.*")
    per = sides.groupBy("cls").agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"),
                                   F.sum("predicted").alias("predicted"))
    rows = per.select(
        "cls", "support", "tp",
        F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0).alias("pr"),
        F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0).alias("re")) \
        .withColumn("f1", F.when(F.col("pr") + F.col("re") > 0, 2 * F.col("pr") * F.col("re")
                                 / (F.col("pr") + F.col("re"))).otherwise(0.0))
    one = rows.agg(
        F.collect_list(F.struct(F.col("cls").alias("class"), F.col("pr").alias("precision"),
                                F.col("re").alias("recall"), "f1", "support")).alias("each"),
        F.sum("support").alias("n"), F.sum("tp").alias("tp"),
        *[F.avg(c).alias(f"m_{c}") for c in ("pr", "re", "f1")],
        *[F.sum(F.col(c) * F.col("support")).alias(f"w_{c}") for c in ("pr", "re", "f1")])
    summary = F.expr("""array(
        struct('accuracy' AS class, CAST(NULL AS DOUBLE) AS precision, CAST(NULL AS DOUBLE) AS recall,
               tp / n AS f1, n AS support),
        struct('macro avg' AS class, m_pr AS precision, m_re AS recall, m_f1 AS f1, n AS support),
        struct('weighted avg' AS class, w_pr / n AS precision, w_re / n AS recall, w_f1 / n AS f1,
               n AS support))""")
    # an empty table has no accuracy to report
    return one.filter("n > 0").select(F.explode(F.concat("each", summary)).alias("r")).select("r.*")


def write_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """Persist the report table (S12); the accuracy row is part of it."""
    writer = report.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def confidence_stats(df: DataFrame, conf: str) -> DataFrame:
    """Mean, population std, min and max of a confidence column."""
    return df.agg(F.avg(conf).alias("mean"), F.stddev_pop(conf).alias("std"),
                  F.min(conf).alias("min"), F.max(conf).alias("max"))


def with_argmax(df: DataFrame, probs: str, idx: str = "pred_idx", top: str = "pred_prob") -> DataFrame:
    """Arg-max (first wins ties) and max of a probability row."""
    return df.withColumns({idx: argmax_index(probs), top: F.array_max(probs).cast("double")})


def prediction_diversity(df: DataFrame, probs: str):
    """Diversity of probability rows (A21), as two tables:

    * overall: distinct predicted classes, mean/std of the row maximum and
      the flags (single class, std < 0.01);
    * per class position: mean/min/max/std of that probability and the
      flag std < 0.001.
    """
    d = with_argmax(df, probs)
    overall = d.agg(
        F.count_distinct("pred_idx").alias("distinct_predicted"),
        F.avg("pred_prob").alias("max_prob_mean"),
        F.stddev_pop("pred_prob").alias("max_prob_std"),
    ).withColumns({
        "single_class": F.col("distinct_predicted") == 1,
        "low_confidence_spread": F.col("max_prob_std") < 0.01,
    })
    per = _stacked(_per_position(df, probs), ["mean", "min", "max", "std"], "pos") \
        .withColumn("flat", F.col("std") < 0.001)
    return overall, per


def _per_position(df: DataFrame, vec: str, keys=()) -> DataFrame:
    """One row (per ``keys``) of arrays: n, mean, std, min and max of each position
    of an array column.

    Cells are exploded and partially aggregated by position in the map tasks, so the
    shuffle carries positions x tasks rows. An aggregate with a column per position
    needs no explode but is beyond what the engine compiles: at 64 positions it took
    three times as long."""
    cells = df.select(*keys, F.posexplode(vec).alias("pos", "x")).groupBy(*keys, "pos").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        F.min("x").cast("double").alias("min"), F.max("x").cast("double").alias("max"))
    names = ("n", "mean", "std", "min", "max")
    rows = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", *names))).alias("p"))
    return rows.select(*keys, *[F.col(f"p.{n}").alias(n) for n in names])


def _stacked(arrays: DataFrame, names: list[str], position: str, keys=()) -> DataFrame:
    """A row per position of parallel arrays."""
    zipped = F.arrays_zip(*names)
    return arrays.select(*keys, F.posexplode(zipped).alias(position, "z")).select(
        *keys, position, *[F.col(f"z.{n}").alias(n) for n in names])


def encoding_health(df: DataFrame, vec: str, sample_col: str | None = None):
    """Health of an encoded array column (A22), as two tables:

    * overall mean/std/min/max over every value, with the flags std < 0.001 and mean
      std over dimensions < 0.01;
    * per dimension mean/std, per sample (e.g. train vs validation) when
      ``sample_col`` is given.
    """
    keys = [sample_col] if sample_col else []
    arrays = _per_position(df, vec, keys)
    # the whole's moments, merged from the positions'
    total = "aggregate(n, 0D, (a, x) -> a + x)"
    weighted = "aggregate(zip_with(n, mean, (a, b) -> a * b), 0D, (a, x) -> a + coalesce(x, 0D))"
    with_mean = arrays.withColumn("t", F.expr(total)).withColumn(
        "m", F.expr(f"CASE WHEN t > 0 THEN {weighted} / t END"))
    spread = ("aggregate(zip_with(zip_with(std, mean, (s, x) -> s * s + (x - m) * (x - m)), n, "
              "(v, k) -> v * k), 0D, (a, x) -> a + coalesce(x, 0D))")
    overall = with_mean.select(
        *keys, F.col("m").alias("mean"), F.sqrt(F.expr(f"CASE WHEN t > 0 THEN {spread} / t END")).alias("std"),
        F.array_min("min").alias("min"), F.array_max("max").alias("max"),
        (F.expr("aggregate(std, 0D, (a, x) -> a + coalesce(x, 0D)) / nullif(size(std), 0)") < 0.01)
        .alias("low_mean_std")).withColumn("low_variance", F.col("std") < 0.001)
    per_dim = _stacked(arrays, ["mean", "std"], "dim", keys)
    return overall, per_dim


def reconstruction_error(df: DataFrame, x: str, xhat: str) -> DataFrame:
    """Mean squared reconstruction error per row, averaged."""
    sq = F.aggregate(F.zip_with(x, xhat, lambda a, b: (a - b) * (a - b)),
                     F.lit(0.0), lambda acc, v: acc + v) / F.size(x)
    return df.agg(F.avg(sq).alias("mse"), F.count(F.lit(1)).alias("rows"))

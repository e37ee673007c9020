"""Table preparation for the models.

A fit is a few aggregations (distinct values of each text column, moments,
classes) over all rows, whose small results come to the driver and are frozen in
a ``Prep`` object; transforms are narrow projections, so applying a fit to a
100 TB table is one scan with no shuffle.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import finite_or_zero

LABEL = "Label"

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude=(LABEL,)) -> list[str]:
    """Numeric columns, label excluded."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def string_columns(df: DataFrame, exclude=(LABEL,)) -> list[str]:
    """String columns, label excluded."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def feature_names(frames: list[DataFrame], label: str = LABEL) -> list[str]:
    """Union of column names over all inputs, label dropped (P4), first-seen
    order; schema only, no scan."""
    seen: dict[str, None] = {}
    for df in frames:
        for c in df.columns:
            if c != label:
                seen.setdefault(c, None)
    return list(seen)


def column_differences(df: DataFrame, reference: list[str], label: str = LABEL):
    """(missing, extra) feature names against a reference list."""
    have = [c for c in df.columns if c != label]
    return ([c for c in reference if c not in set(have)],
            [c for c in have if c not in set(reference)])


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Union all by name; a column missing from an input is null there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def bad_cells(df: DataFrame, label: str = LABEL):
    """Aggregate: null, NaN or infinite cells over all columns but the label."""
    terms = []
    for f in df.schema.fields:
        if f.name == label:
            continue
        x = F.col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
        else:
            bad = x.isNull()
        terms.append(F.count_if(bad))
    total = terms[0] if terms else F.lit(0)
    for t in terms[1:]:
        total = total + t
    return total.cast("long").alias("bad_cells")


def bad_cell_count(df: DataFrame, label: str = LABEL) -> DataFrame:
    """The bad cells of a table."""
    return df.agg(bad_cells(df, label))


def clean(df: DataFrame, label: str = LABEL) -> DataFrame:
    """null/NaN/inf -> 0 in numeric columns, null -> '0' in text columns."""
    cols = []
    for f in df.schema.fields:
        if f.name == label:
            cols.append(F.col(f.name))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            cols.append(finite_or_zero(f.name).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, NUMERIC):
            cols.append(F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(F.coalesce(F.col(f.name), F.lit("0")).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def column_types(df: DataFrame) -> dict[str, str]:
    """Type names by column, to freeze beside a feature list."""
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def _zero(name: str, types: dict[str, str]):
    """What a missing column holds: 0 of its type, the text '0' in a text column."""
    kind = types.get(name, "double")
    return F.lit("0" if kind == "string" else 0).cast(kind).alias(name)


def align(df: DataFrame, features: list[str], label: str | None = LABEL,
          types: dict[str, str] | None = None) -> DataFrame:
    """Exactly ``features`` in that order (missing ones as 0 of their frozen type),
    plus the label when present (P5, P6, P7): one ``select``."""
    have = set(df.columns)
    cols = [F.col(c) if c in have else _zero(c, types or {}) for c in features]
    if label and label in have:
        cols.append(F.col(label))
    return df.select(*cols)


# --- one-hot (T1) ---------------------------------------------------------

MAX_CATEGORIES = 10_000
OTHER = None                 # stands in a category list for all values that are not in it


def fit_categories(df: DataFrame, columns: list[str],
                   max_categories: int = MAX_CATEGORIES) -> dict[str, list]:
    """Sorted distinct values of each text column, all columns in one pass. Of a column
    with more than ``max_categories`` values (an id or address left among the features)
    the most frequent ones stay, ties by value, and the list ends with ``OTHER``: all
    other values share one indicator, so no row's value is lost without a trace. At most
    one value above the limit of a column reaches the driver."""
    if not columns:
        return {}
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v"))
                                          for i, c in enumerate(columns)])).alias("c")).select("c.*")
    counts = cells.filter(F.col("v").isNotNull()).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    # a limited window: each task keeps that many values a column before the shuffle
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "v"))
    found: dict[int, list] = {}
    for r in counts.withColumn("r", rank).filter(F.col("r") <= max_categories + 1).collect():
        found.setdefault(r["i"], []).append((r["r"], r["v"]))
    out = {}
    for i, c in enumerate(columns):
        values = sorted(v for r, v in found.get(i, []) if r <= max_categories)
        out[c] = values + [OTHER] if len(found.get(i, [])) > max_categories else values
    return out


def one_hot(df: DataFrame, categories: dict[str, list], drop_first: bool = True) -> DataFrame:
    """Replace each text column by 0/1 columns ``col_value``; the first
    category in sort order is dropped. Non-text columns keep their order and
    the indicators follow them, column by column; a column's last is ``col_<other>``
    where its list ends with ``OTHER``."""
    keep = [F.col(c) for c in df.columns if c not in categories]
    ind = []
    for c, values in categories.items():
        for v in (values[1:] if drop_first else values):
            if v is OTHER:
                one, name = F.col(c).isNotNull() & ~F.col(c).isin(values[:-1]), f"{c}_<other>"
            else:
                one, name = F.col(c) == v, f"{c}_{v}"
            ind.append(F.when(one, 1).otherwise(0).cast("int").alias(name))
    return df.select(*keep, *ind)


# --- scaler (T2) and moments (A12, A13, A14) --------------------------------

def fit_scaler(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per feature; a zero std scales by 1."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    out = {}
    for i, c in enumerate(features):
        m, s = row[f"m{i}"], row[f"s{i}"]
        out[c] = (float(m or 0.0), float(s) if s else 1.0)
    return out


def scale(df: DataFrame, stats: dict[str, tuple[float, float]], label: str | None = LABEL,
          as_float: bool = True) -> DataFrame:
    """(x - mean) / std per feature (T2), optionally cast to float32."""
    cols = []
    for c in df.columns:
        if c in stats:
            m, s = stats[c]
            x = (F.col(c) - F.lit(m)) / F.lit(s)
            cols.append((x.cast("float") if as_float else x).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def feature_moments(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: mean, sample std, min, max, count (A14), plus the floored
    std used for synthetic rows: max(std, 0.01 * |mean|, or 0.01 when mean
    is 0), NaN mean -> 0, NaN std -> 1 (A12)."""
    aggs = []
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                 F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.count(x).alias(f"n{i}")]
    # one row of moments, stacked into a row per feature
    rows = ", ".join(f"'{c}', mean{i}, std{i}, min{i}, max{i}, n{i}" for i, c in enumerate(features))
    s = df.agg(*aggs).select(F.expr(
        f"stack({len(features)}, {rows}) AS (feature, mean, std, min, max, n)"))
    mean0 = F.coalesce(F.when(~F.isnan("mean"), F.col("mean")), F.lit(0.0))
    std1 = F.coalesce(F.when(~F.isnan("std"), F.col("std")), F.lit(1.0))
    floor = F.when(mean0 != 0, 0.01 * F.abs(mean0)).otherwise(0.01)
    return s.withColumns({
        "gen_mean": mean0,
        "gen_std": F.greatest(std1, floor),
    })


def moments_dict(moments: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Small fit result -> {feature: (mean, floored std)} in feature order."""
    rows = {r["feature"]: (r["gen_mean"], r["gen_std"]) for r in
            moments.select("feature", "gen_mean", "gen_std").collect()}
    return {f: rows[f] for f in features if f in rows}


BASELINE_FEATURES = ["flow_duration", "pkt_count", "total_size", "mean_iat"]


def normal_baseline(normal: DataFrame) -> DataFrame:
    """Mean and sample std of four flow features; an absent column gives
    mean 0 and std 1 (A13). One row."""
    aggs = []
    for c in BASELINE_FEATURES:
        if c in normal.columns:
            aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
        else:
            aggs += [F.lit(0.0).alias(f"{c}_mean"), F.lit(1.0).alias(f"{c}_std")]
    return normal.agg(*aggs)


# --- labels (T3, J3) and class tables (A9, A10, A11, J4, W5) ---------------

MAX_CLASSES = 10_000


def fit_labels(df: DataFrame, label: str = LABEL) -> list[str]:
    """Sorted distinct labels (T3), nulls aside; above ``MAX_CLASSES`` the column
    holds no classes, which raises."""
    rows = df.select(label).filter(F.col(label).isNotNull()).distinct() \
        .limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values")
    return sorted(r[0] for r in rows)


def label_index(df: DataFrame, classes: list[str], label: str = LABEL,
                out: str = "label_idx") -> DataFrame:
    """Label -> code by the frozen class list (J3); an unseen label gets null
    rather than re-fitting (K11)."""
    m = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
    return df.withColumn(out, m[F.col(label)].cast("int"))


def index_label(df: DataFrame, classes: list[str], idx: str = "pred_idx",
                out: str = "pred_label") -> DataFrame:
    """Code -> label text."""
    arr = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(out, F.element_at(arr, F.col(idx) + 1))


def label_codes(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Label code table by dense rank over the distinct labels (T3 as a plan)."""
    d = df.select(label).distinct()
    return d.select(label, (F.dense_rank().over(Window.orderBy(label)) - 1).alias("code"))


def class_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Count and percentage per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return c.withColumn("percentage", F.col("count") / F.sum("count").over(Window.partitionBy()) * 100)


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weight n / (classes * count) per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    allw = Window.partitionBy()
    return c.select(
        label, "count",
        F.count(F.lit(1)).over(allw).alias("n_classes"),
        (F.sum("count").over(allw) / (F.count(F.lit(1)).over(allw) * F.col("count"))).alias("weight"),
    )


def fit_weights(df: DataFrame, label: str = LABEL) -> dict[str, float]:
    """Balanced weight by class, from one row per class."""
    rows = class_weights(df, label).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values")
    return {r[label]: r["weight"] for r in rows if r[label] is not None}


def with_weights(df: DataFrame, weights: dict[str, float], label: str = LABEL,
                 out: str = "weight") -> DataFrame:
    """Per-row weight by class, 1.0 when the class has none (J4): a look-up in a
    map literal, so no row is shuffled."""
    if not weights:
        return df.withColumn(out, F.lit(1.0))
    m = F.create_map(*[x for k, w in sorted(weights.items()) for x in (F.lit(k), F.lit(float(w)))])
    return df.withColumn(out, F.coalesce(m[F.col(label)], F.lit(1.0)))


# --- the fitted preprocessor (T4) ------------------------------------------

@dataclass
class Prep:
    """Frozen preprocessing state: everything ``transform`` needs."""
    features: list[str] = field(default_factory=list)       # after one-hot
    raw_features: list[str] = field(default_factory=list)   # before one-hot
    categories: dict = field(default_factory=dict)
    scaler: dict = field(default_factory=dict)
    classes: list[str] = field(default_factory=list)
    label: str = LABEL
    types: dict = field(default_factory=dict)               # of the raw features

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Prep":
        d = json.loads(text)
        d["scaler"] = {k: tuple(v) for k, v in d["scaler"].items()}
        return Prep(**d)

    # fit: P2 -> P5-7 (against all names) -> T1 -> T2 -> T3
    @staticmethod
    def fit(df: DataFrame, all_features: list[str] | None = None, label: str = LABEL) -> "Prep":
        names = all_features or [c for c in df.columns if c != label]
        types = {c: t for c, t in column_types(df).items() if c in set(names)}
        data = align(clean(df, label), names, label, types)
        cats = fit_categories(data, string_columns(data, (label,)))
        encoded = one_hot(data, cats)
        feats = [c for c in encoded.columns if c != label]
        return Prep(features=feats, raw_features=names, categories=cats,
                    scaler=fit_scaler(encoded, feats), classes=fit_labels(df, label),
                    label=label, types=types)

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Apply the frozen state: categories first, then alignment (K9);
        adds ``features`` array<float> (P15) and ``label_idx`` when the label
        is present. ``keep`` columns pass through."""
        data = clean(df, self.label)
        have = set(data.columns)
        raw = set(self.raw_features)
        passthru = [c for c in data.columns
                    if (c == self.label or c in keep) and c not in raw]
        data = data.select(*[F.col(c) if c in have else _zero(c, self.types)
                             for c in self.raw_features], *passthru)
        encoded = one_hot(data, self.categories)
        have = set(encoded.columns)
        feats = [F.col(c) if c in have else F.lit(0).cast("int").alias(c) for c in self.features]
        scaled = scale(encoded.select(*feats, *passthru), self.scaler, None, as_float=True)
        out = scaled.select(F.array(*[F.col(c) for c in self.features]).alias("features"),
                            *passthru)
        if self.label in out.columns:
            out = label_index(out, self.classes, self.label)
        return out

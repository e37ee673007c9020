"""Registered table-preparation, sampling and evaluation queries.

Stand-ins from the driver tables (see FIXTURES.md): ``lineitem`` rows split by
``l_returnflag`` play the per-class datasets, ``customer``/``orders`` text
columns the categorical features, ``labels`` a truth/prediction pair and
``embeddings`` the probability and encoding rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import prepare as P
from ..operators import sampling as S
from . import sql_fixtures as sqlf
from .output import r6, round_doubles
from .tables import table

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_linenumber"]
ALL_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
          "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
          "l_shipdate"]
# Column subsets that make the three datasets' schemas differ.
SOURCES = {"A": ["l_quantity", "l_extendedprice"],
           "N": ["l_quantity", "l_discount", "l_tax"],
           "R": ["l_extendedprice", "l_discount"]}

# Portable, overflow-safe pseudo-random order key for the exact splits; ties
# broken by every column, so the order is total in both engines.
SPLIT_KEY_SQL = ("((l_orderkey % 1000003) * 7919 + l_linenumber * 104729 "
                 "+ (l_partkey % 1000003) * 31) % 1000003")


def _lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def datasets(spark, sf_dir):
    li = _lineitem(spark, sf_dir)
    return [li.filter(F.col("l_returnflag") == k).select(*KEYS, *cols).withColumn(P.LABEL, F.lit(k))
            for k, cols in SOURCES.items()]


def q_union_align(spark, sf_dir):
    frames = datasets(spark, sf_dir)
    feats = P.feature_names(frames)
    u = P.clean(P.union_by_name(frames))
    return round_doubles(P.align(u, feats))


def q_bad_cells(spark, sf_dir):
    return P.bad_cell_count(P.union_by_name(datasets(spark, sf_dir)))


def q_one_hot_customer(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    cats = P.fit_categories(c, ["c_mktsegment"])
    return round_doubles(P.one_hot(c, cats))


def q_one_hot_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    cats = P.fit_categories(o, ["o_orderpriority"])
    return round_doubles(P.one_hot(o, cats))


FOLD_AT = 4                # categories kept of each column


def q_one_hot_folded(spark, sf_dir):
    """Indicators of two wide text columns, rare values folded into one (T1): how many
    rows each marks. The first category in sort order has none."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    cats = P.fit_categories(p, ["p_brand", "p_type"], FOLD_AT)
    hot = P.one_hot(p, cats)
    marks = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(v or "<other>").alias("category"),
                               F.col(f"`{c}_{v or '<other>'}`").alias("one"))
                      for c, values in cats.items() for v in values[1:]])
    return hot.select(F.explode(marks).alias("m")).groupBy("m.column", "m.category").agg(
        F.sum("m.one").alias("ones"))


def q_standardize(spark, sf_dir):
    li = _lineitem(spark, sf_dir).select(*KEYS, "l_partkey", *NUM)
    return round_doubles(P.scale(li, P.fit_scaler(li, NUM), None, as_float=False))


def q_label_codes(spark, sf_dir):
    li = _lineitem(spark, sf_dir).select(F.col("l_returnflag").alias(P.LABEL))
    return P.label_codes(li)


def q_class_distribution(spark, sf_dir):
    li = _lineitem(spark, sf_dir).select(F.col("l_returnflag").alias(P.LABEL))
    return round_doubles(P.class_distribution(li))


def q_class_weights(spark, sf_dir):
    li = _lineitem(spark, sf_dir).select(F.col("l_returnflag").alias(P.LABEL))
    return round_doubles(P.class_weights(li))


def q_row_weights(spark, sf_dir):
    li = _lineitem(spark, sf_dir).select(*KEYS, "l_partkey", F.col("l_returnflag").alias(P.LABEL))
    return round_doubles(P.with_weights(li, P.fit_weights(li)))


def q_feature_moments(spark, sf_dir):
    return round_doubles(P.feature_moments(_lineitem(spark, sf_dir), NUM))


def q_normal_baseline(spark, sf_dir):
    from .traffic import labelled
    normal = labelled(spark, sf_dir, "mixed").filter(F.col("label") == "Normal")
    return round_doubles(P.normal_baseline(normal))


def q_first_rows_per_class(spark, sf_dir):
    li = _lineitem(spark, sf_dir)
    return round_doubles(S.first_n_per_group(li, ["l_returnflag"], ALL_LI, 1000))


def _split_order():
    return [F.expr(SPLIT_KEY_SQL), *ALL_LI]


def q_stratified_split(spark, sf_dir):
    li = _lineitem(spark, sf_dir)
    return round_doubles(S.stratified_split(li, "l_returnflag", 20, _split_order()))


def q_first_rows_bucketed(spark, sf_dir):
    # The path of large quotas and groups at test scale.
    li = _lineitem(spark, sf_dir)
    return round_doubles(S.first_n_per_group(li, ["l_returnflag"], ALL_LI, 1000, rows_per_range=256))


def q_stratified_split_bucketed(spark, sf_dir):
    li = _lineitem(spark, sf_dir)
    return round_doubles(S.stratified_split(li, "l_returnflag", 20, _split_order(),
                                            rows_per_range=256))


def q_three_way_split(spark, sf_dir):
    li = _lineitem(spark, sf_dir)
    return round_doubles(S.three_way_split(li, "l_returnflag", _split_order()))


def q_sample_counts(spark, sf_dir):
    li = _lineitem(spark, sf_dir)
    s = S.sample_per_group(li, ["l_returnflag"], 1000, seed=42)
    return s.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("sampled"))


def _text_split_rows(spark, sf_dir):
    """Orders with a null class (one priority) and a text key."""
    o = table(spark, sf_dir, "orders")
    cls = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority"))
    key = F.concat(F.lit("Clerk of the order numbered "), (F.col("o_orderkey") % 997).cast("string"))
    return o.select("o_orderkey", cls.alias("cls"), key.alias("key"))


def q_split_null_class(spark, sf_dir):
    """A null class is split like any other; a descending text key orders it."""
    rows = _text_split_rows(spark, sf_dir)
    return S.three_way_split(rows, "cls", [("key", "desc"), "o_orderkey"], rows_per_range=128)


def q_first_rows_null_class(spark, sf_dir):
    rows = _text_split_rows(spark, sf_dir)
    return S.first_n_per_group(rows, ["cls"], ["key", ("o_orderkey", "desc")], 500, rows_per_range=128)


SYNTHETIC_PCT = 15


def _synthetic_training(spark, sf_dir):
    """lineitem classes with synthetic Normal rows appended."""
    li = _lineitem(spark, sf_dir).select(*NUM, F.col("l_returnflag").alias(P.LABEL))
    stats = P.moments_dict(P.feature_moments(li, NUM), NUM)
    n = li.count() * SYNTHETIC_PCT // 100
    return S.with_synthetic_normal(li, stats, n), stats, n


def q_synthetic_normal(spark, sf_dir):
    """Rows per class after appending; the synthetic rows' moments must lie within
    six standard errors of what they were drawn from."""
    rows, stats, n = _synthetic_training(spark, sf_dir)
    ok = F.lit(True)
    for c, (mean, std) in stats.items():
        near = F.abs(F.avg(c) - mean) <= 6 * 0.75 * std / max(n, 1) ** 0.5
        spread = F.abs(F.stddev_samp(c) / (0.75 * std) - 1) <= 6 / max(2 * n, 1) ** 0.5
        ok = ok & near & spread
    return rows.groupBy(P.LABEL).agg(F.count(F.lit(1)).alias("rows"),
                                     F.coalesce(ok, F.lit(True)).alias("drawn")) \
        .withColumn("moments_ok", (F.col(P.LABEL) != "Normal") | F.col("drawn")).drop("drawn")


def _dirty(spark, sf_dir):
    """lineitem numbers with NaN, both infinities and nulls put in by position."""
    li = _lineitem(spark, sf_dir)
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 7
    bad = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")) \
        .when(k == 3, F.lit(None).cast("double"))
    return li.select(*KEYS, F.coalesce(bad, F.when(k != 3, F.col("l_quantity"))).alias("l_quantity"),
                     F.when(k != 4, F.col("l_tax")).alias("l_tax"),
                     F.when(k != 5, F.col("l_linestatus")).alias("l_linestatus"), "l_partkey")


def q_clean_dirty(spark, sf_dir):
    return round_doubles(P.clean(_dirty(spark, sf_dir)))


def q_align_columns(spark, sf_dir):
    """A missing feature, an extra column and another order."""
    li = _lineitem(spark, sf_dir).select("l_tax", "l_suppkey", *KEYS, "l_quantity")
    wanted = [*KEYS, "l_quantity", "l_discount", "l_tax", "l_linestatus"]
    types = P.column_types(_lineitem(spark, sf_dir))
    return round_doubles(P.align(li, wanted, None, types))


def q_column_differences(spark, sf_dir):
    """Missing and extra names of each dataset against the union of all."""
    frames = datasets(spark, sf_dir)
    wanted = P.feature_names(frames)[:5]
    parts = []
    for f in frames:
        missing, extra = P.column_differences(f, wanted)
        parts.append(f.groupBy(P.LABEL).agg(F.count(F.lit(1)).alias("rows")).withColumns(
            {"missing": F.lit(",".join(missing)), "extra": F.lit(",".join(extra))}))
    return P.union_by_name(parts)


def q_prep_values(spark, sf_dir):
    """Every prepared value of the real path: clean, align, one-hot, scale, cast."""
    li = _lineitem(spark, sf_dir).select(*KEYS, "l_quantity", "l_tax", "l_linestatus",
                                         F.col("l_returnflag").alias(P.LABEL))
    prep = P.Prep.fit(li.drop(*KEYS))
    out = prep.transform(li, keep=KEYS)
    # float32 values, rounded to what float32 holds
    return out.select(*KEYS, "label_idx", *[
        (F.floor(F.col("features")[i].cast("double") * 1e4 + 0.5) / 1e4).alias(f"f{i}")
        for i in range(len(prep.features))])


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels")


def q_accuracy(spark, sf_dir):
    return round_doubles(M.accuracy(_labels(spark, sf_dir), "quality", "toxic"))


def q_validation_gate(spark, sf_dir):
    return round_doubles(M.validation_gate(_labels(spark, sf_dir), "quality", "toxic"))


def q_confusion(spark, sf_dir):
    return M.confusion(_labels(spark, sf_dir), "quality", "toxic")


def q_report(spark, sf_dir):
    return round_doubles(M.classification_report(_labels(spark, sf_dir), "quality", "toxic"))


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def q_matrix_preview(spark, sf_dir):
    p = M.matrix_preview(_emb(spark, sf_dir), "embedding", "vec_id")
    return round_doubles(p.withColumn("value", F.col("value").cast("double")))


def q_argmax(spark, sf_dir):
    e = M.with_argmax(_emb(spark, sf_dir), "embedding")
    return round_doubles(e.select("vec_id", "label", "pred_idx", "pred_prob"))


def q_confidence_stats(spark, sf_dir):
    e = M.with_argmax(_emb(spark, sf_dir), "embedding")
    return round_doubles(M.confidence_stats(e, "pred_prob"))


def q_diversity_overall(spark, sf_dir):
    return round_doubles(M.prediction_diversity(_emb(spark, sf_dir), "embedding")[0])


def q_diversity_per_class(spark, sf_dir):
    return round_doubles(M.prediction_diversity(_emb(spark, sf_dir), "embedding")[1])


def _emb_split(spark, sf_dir):
    return S.stratified_split(_emb(spark, sf_dir), "label", 20, [F.col("vec_id")], out="sample")


def q_encoding_overall(spark, sf_dir):
    return round_doubles(M.encoding_health(_emb_split(spark, sf_dir), "embedding", "sample")[0])


def q_encoding_per_dim(spark, sf_dir):
    return round_doubles(M.encoding_health(_emb_split(spark, sf_dir), "embedding", "sample")[1])


QUERIES = {
    "union_align": q_union_align,
    "bad_cells": q_bad_cells,
    "one_hot_customer": q_one_hot_customer,
    "one_hot_orders": q_one_hot_orders,
    "one_hot_folded": q_one_hot_folded,
    "standardize": q_standardize,
    "label_codes": q_label_codes,
    "class_distribution": q_class_distribution,
    "class_weights": q_class_weights,
    "row_weights": q_row_weights,
    "feature_moments": q_feature_moments,
    "normal_baseline": q_normal_baseline,
    "first_rows_per_class": q_first_rows_per_class,
    "stratified_split": q_stratified_split,
    "three_way_split": q_three_way_split,
    "first_rows_bucketed": q_first_rows_bucketed,
    "stratified_split_bucketed": q_stratified_split_bucketed,
    "sample_counts": q_sample_counts,
    "synthetic_normal": q_synthetic_normal,
    "split_null_class": q_split_null_class,
    "first_rows_null_class": q_first_rows_null_class,
    "clean_dirty": q_clean_dirty,
    "align_columns": q_align_columns,
    "column_differences": q_column_differences,
    "prep_values": q_prep_values,
    "accuracy": q_accuracy,
    "validation_gate": q_validation_gate,
    "confusion": q_confusion,
    "classification_report": q_report,
    "matrix_preview": q_matrix_preview,
    "argmax": q_argmax,
    "confidence_stats": q_confidence_stats,
    "diversity_overall": q_diversity_overall,
    "diversity_per_class": q_diversity_per_class,
    "encoding_overall": q_encoding_overall,
    "encoding_per_dim": q_encoding_per_dim,
}


# --- oracle SQL ------------------------------------------------------------

def _union_sql(fill: bool) -> str:
    parts = []
    allc = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    for k, cols in SOURCES.items():
        sel = ", ".join(c if c in cols else (f"0.0 AS {c}" if fill else f"CAST(NULL AS DOUBLE) AS {c}")
                        for c in allc)
        parts.append(f"SELECT l_orderkey, l_linenumber, {sel}, '{k}' AS Label "
                     f"FROM lineitem WHERE l_returnflag = '{k}'")
    return " UNION ALL ".join(parts)


def _one_hot_sql(tbl, key, num, col, values):
    ind = ", ".join(f"CAST(CASE WHEN {col} = '{v}' THEN 1 ELSE 0 END AS INTEGER) AS \"{col}_{v}\""
                    for v in values[1:])
    return f"SELECT {key}, {r6(num)} AS {num}, {ind} FROM {tbl}"


def _moments_sql():
    parts = []
    for c in NUM:
        parts.append(f"""SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std,
                         min({c}) AS min, max({c}) AS max, count({c}) AS n FROM lineitem""")
    u = " UNION ALL ".join(parts)
    return f"""SELECT feature, {r6('mean')} AS mean, {r6('std')} AS std, {r6('min')} AS min,
                      {r6('max')} AS max, CAST(n AS BIGINT) AS n, {r6('coalesce(mean, 0.0)')} AS gen_mean,
                      {r6('greatest(coalesce(std, 1.0), CASE WHEN coalesce(mean, 0.0) <> 0 THEN 0.01 * abs(coalesce(mean, 0.0)) ELSE 0.01 END)')} AS gen_std
               FROM ({u})"""


_ALL_ORDER = ", ".join(ALL_LI)
_LI_OUT = ", ".join(r6(c) + f" AS {c}" if c in NUM else c for c in ALL_LI)


def _split_sql():
    return f"""
    SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {SPLIT_KEY_SQL}, {_ALL_ORDER}) AS rk1,
              count(*) OVER (PARTITION BY l_returnflag) AS n1
    FROM lineitem"""


def _report_sql():
    return f"""
    WITH b AS (SELECT CAST(quality AS VARCHAR) AS t, CAST(toxic AS VARCHAR) AS p FROM labels),
    pt AS (SELECT t AS cls, count(*) AS support, count_if(t = p) AS tp FROM b GROUP BY t),
    pp AS (SELECT p AS cls, count(*) AS predicted FROM b GROUP BY p),
    j AS (SELECT coalesce(pt.cls, pp.cls) AS cls, coalesce(support, 0) AS support,
                 coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted
          FROM pt FULL JOIN pp ON pt.cls = pp.cls),
    r AS (SELECT cls, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
                 CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, support, tp FROM j),
    f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                         ELSE 0.0 END AS f1 FROM r),
    s AS (SELECT sum(support) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
                 sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
                 sum(f1 * support) / sum(support) AS wf FROM f)
    SELECT cls AS class, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1,
           CAST(support AS BIGINT) AS support FROM f
    UNION ALL SELECT 'accuracy', NULL, NULL, {r6('tp / n')}, CAST(n AS BIGINT) FROM s
    UNION ALL SELECT 'macro avg', {r6('mp')}, {r6('mr')}, {r6('mf')}, CAST(n AS BIGINT) FROM s
    UNION ALL SELECT 'weighted avg', {r6('wp')}, {r6('wr')}, {r6('wf')}, CAST(n AS BIGINT) FROM s"""


_EMB_SPLIT = """
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY vec_id)
                        <= (count(*) OVER (PARTITION BY label) * 20 + 99) // 100
                   THEN 'test' ELSE 'train' END AS sample
    FROM embeddings"""

_FLOWS_NORMAL = f"""
    SELECT f.* FROM ({sqlf.flows_sql('mixed')}) f
    JOIN ({sqlf.signatures_sql('mixed')}) s USING (capture_id, src_ip, dst_ip, src_port, dst_port, proto)
    WHERE s.sig_type = 'Normal'"""

ORACLE = {
    "union_align": f"""SELECT l_orderkey, l_linenumber, {', '.join(r6(c) + ' AS ' + c for c in NUM)}, Label
                       FROM ({_union_sql(True)})""",
    "bad_cells": f"""SELECT CAST(sum((l_quantity IS NULL OR isnan(l_quantity) OR isinf(l_quantity))::INT
                         + (l_extendedprice IS NULL OR isnan(l_extendedprice) OR isinf(l_extendedprice))::INT
                         + (l_discount IS NULL OR isnan(l_discount) OR isinf(l_discount))::INT
                         + (l_tax IS NULL OR isnan(l_tax) OR isinf(l_tax))::INT
                         + (l_orderkey IS NULL)::INT + (l_linenumber IS NULL)::INT) AS BIGINT) AS bad_cells
                     FROM ({_union_sql(False)})""",
    "one_hot_customer": _one_hot_sql("customer", "c_custkey", "c_acctbal", "c_mktsegment",
                                     ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]),
    "one_hot_orders": _one_hot_sql("orders", "o_orderkey", "o_totalprice", "o_orderpriority",
                                   ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]),
    "one_hot_folded": f"""
        WITH x AS (SELECT 'p_brand' AS "column", p_brand AS v FROM part WHERE p_brand IS NOT NULL
                   UNION ALL SELECT 'p_type', p_type FROM part WHERE p_type IS NOT NULL),
        n AS (SELECT "column", v, count(*) AS n,
                     row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, v) AS place
              FROM x GROUP BY "column", v),
        k AS (SELECT "column", CASE WHEN place <= {FOLD_AT} THEN v ELSE '<other>' END AS category, sum(n) AS ones,
                     min(place) AS place FROM n GROUP BY 1, 2)
        SELECT "column", category, CAST(ones AS BIGINT) AS ones FROM k
        QUALIFY place > {FOLD_AT} OR row_number() OVER (PARTITION BY "column", place > {FOLD_AT} ORDER BY category) > 1""",
    "standardize": f"""SELECT l_orderkey, l_linenumber, l_partkey,
        {', '.join(r6(f'({c} - avg({c}) OVER ()) / CASE WHEN coalesce(stddev_pop({c}) OVER (), 0) = 0 THEN 1 ELSE stddev_pop({c}) OVER () END') + ' AS ' + c for c in NUM)}
        FROM lineitem""",
    "label_codes": """SELECT Label, CAST(dense_rank() OVER (ORDER BY Label) - 1 AS INTEGER) AS code
                      FROM (SELECT DISTINCT l_returnflag AS Label FROM lineitem)""",
    "class_distribution": f"""SELECT Label, CAST(count AS BIGINT) AS count, {r6('count / sum(count) OVER () * 100')} AS percentage
                              FROM (SELECT l_returnflag AS Label, count(*) AS count FROM lineitem GROUP BY 1)""",
    "class_weights": f"""SELECT Label, CAST(count AS BIGINT) AS count, CAST(count(*) OVER () AS BIGINT) AS n_classes,
                                {r6('sum(count) OVER () / (count(*) OVER () * count)')} AS weight
                         FROM (SELECT l_returnflag AS Label, count(*) AS count FROM lineitem GROUP BY 1)""",
    "row_weights": f"""WITH w AS (SELECT Label, sum(count) OVER () / (count(*) OVER () * count) AS weight
                                  FROM (SELECT l_returnflag AS Label, count(*) AS count FROM lineitem GROUP BY 1))
                       SELECT l.l_returnflag AS Label, l_orderkey, l_linenumber, l_partkey, {r6('coalesce(w.weight, 1.0)')} AS weight
                       FROM lineitem l LEFT JOIN w ON w.Label = l.l_returnflag""",
    "feature_moments": _moments_sql(),
    "normal_baseline": f"""SELECT {r6('avg(flow_duration)')} AS flow_duration_mean, {r6('stddev_samp(flow_duration)')} AS flow_duration_std,
                                  {r6('avg(pkt_count)')} AS pkt_count_mean, {r6('stddev_samp(pkt_count)')} AS pkt_count_std,
                                  {r6('avg(total_size)')} AS total_size_mean, {r6('stddev_samp(total_size)')} AS total_size_std,
                                  {r6('avg(mean_iat)')} AS mean_iat_mean, {r6('stddev_samp(mean_iat)')} AS mean_iat_std
                           FROM ({_FLOWS_NORMAL})""",
    "first_rows_per_class": f"""SELECT {_LI_OUT} FROM (
        SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {_ALL_ORDER}) AS rk FROM lineitem)
        WHERE rk <= 1000""",
    "stratified_split": f"""SELECT {_LI_OUT}, CASE WHEN rk1 <= (n1 * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS split
                            FROM ({_split_sql()})""",
    "three_way_split": f"""
        WITH a AS ({_split_sql()}),
        tr AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {SPLIT_KEY_SQL}, {_ALL_ORDER}) AS rk2,
                         count(*) OVER (PARTITION BY l_returnflag) AS n2
               FROM a WHERE rk1 > (n1 * 20 + 99) // 100)
        SELECT {_LI_OUT}, CASE WHEN rk2 <= (n2 * 20 + 99) // 100 THEN 'validation' ELSE 'train' END AS split FROM tr
        UNION ALL
        SELECT {_LI_OUT}, 'test' AS split FROM a WHERE rk1 <= (n1 * 20 + 99) // 100""",
    "sample_counts": """SELECT l_returnflag, CAST(least(count(*), 1000) AS BIGINT) AS sampled
                        FROM lineitem GROUP BY l_returnflag""",
    "accuracy": f"""SELECT {r6('avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END)')} AS accuracy,
                           CAST(count(*) AS BIGINT) AS rows FROM labels""",
    "validation_gate": f"""SELECT {r6('acc')} AS accuracy, rows, acc >= 0.9 AS meets_target FROM (
                             SELECT avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS acc,
                                    CAST(count(*) AS BIGINT) AS rows FROM labels)""",
    "confusion": """SELECT quality AS truth, toxic AS predicted, CAST(count(*) AS BIGINT) AS count
                    FROM labels GROUP BY quality, toxic""",
    "classification_report": _report_sql(),
    "matrix_preview": f"""SELECT vec_id, CAST(k AS INTEGER) AS position, {r6('embedding[k + 1]')} AS value
        FROM (SELECT vec_id, embedding FROM embeddings ORDER BY vec_id LIMIT 5), range(5) AS r(k)""",
    "argmax": f"""SELECT vec_id, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred_idx,
                         {r6('CAST(list_max(embedding) AS DOUBLE)')} AS pred_prob FROM embeddings""",
    "confidence_stats": f"""SELECT {r6('avg(m)')} AS mean, {r6('stddev_pop(m)')} AS std, {r6('min(m)')} AS min, {r6('max(m)')} AS max
                            FROM (SELECT CAST(list_max(embedding) AS DOUBLE) AS m FROM embeddings)""",
    "diversity_overall": f"""SELECT CAST(count(DISTINCT i) AS BIGINT) AS distinct_predicted, {r6('avg(m)')} AS max_prob_mean,
                                    {r6('stddev_pop(m)')} AS max_prob_std, count(DISTINCT i) = 1 AS single_class,
                                    stddev_pop(m) < 0.01 AS low_confidence_spread
                             FROM (SELECT list_position(embedding, list_max(embedding)) - 1 AS i,
                                          CAST(list_max(embedding) AS DOUBLE) AS m FROM embeddings)""",
    "diversity_per_class": f"""SELECT CAST(pos AS INTEGER) AS pos, {r6('avg(p)')} AS mean, {r6('min(p)')} AS min,
                                      {r6('max(p)')} AS max, {r6('stddev_pop(p)')} AS std, stddev_pop(p) < 0.001 AS flat
                               FROM (SELECT generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS p FROM embeddings)
                               GROUP BY pos""",
    "encoding_overall": f"""WITH x AS (SELECT sample, generate_subscripts(embedding, 1) AS dim, unnest(embedding) AS x
                                       FROM ({_EMB_SPLIT})),
                                 d AS (SELECT sample, avg(s) < 0.01 AS low FROM (
                                         SELECT sample, dim, stddev_pop(x) AS s FROM x GROUP BY ALL) GROUP BY sample)
                            SELECT sample, {r6('avg(x)')} AS mean, {r6('stddev_pop(x)')} AS std, {r6('min(x)')} AS min,
                                   {r6('max(x)')} AS max, stddev_pop(x) < 0.001 AS low_variance,
                                   any_value(low) AS low_mean_std
                            FROM x JOIN d USING (sample) GROUP BY sample""",
    "encoding_per_dim": f"""SELECT sample, CAST(dim AS INTEGER) AS dim, {r6('avg(x)')} AS mean, {r6('stddev_pop(x)')} AS std
                            FROM (SELECT sample, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS x
                                  FROM ({_EMB_SPLIT})) GROUP BY sample, dim""",
}
ORACLE["first_rows_bucketed"] = ORACLE["first_rows_per_class"]
ORACLE["stratified_split_bucketed"] = ORACLE["stratified_split"]

_TEXT_ROWS = """SELECT o_orderkey, CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END AS cls,
                       'Clerk of the order numbered ' || (o_orderkey % 997) AS key FROM orders"""
ORACLE["split_null_class"] = f"""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY key DESC, o_orderkey) AS rk,
                      count(*) OVER (PARTITION BY cls) AS n FROM ({_TEXT_ROWS})),
    c AS (SELECT *, (n * 20 + 99) // 100 AS t FROM r)
    SELECT o_orderkey, cls, key, CASE WHEN rk <= t THEN 'test'
           WHEN rk <= t + ((n - t) * 20 + 99) // 100 THEN 'validation' ELSE 'train' END AS split FROM c"""
ORACLE["first_rows_null_class"] = f"""
    SELECT o_orderkey, cls, key FROM ({_TEXT_ROWS})
    QUALIFY row_number() OVER (PARTITION BY cls ORDER BY key, o_orderkey DESC) <= 500"""
ORACLE["synthetic_normal"] = f"""
    SELECT l_returnflag AS Label, CAST(count(*) AS BIGINT) AS rows, true AS moments_ok FROM lineitem GROUP BY 1
    UNION ALL SELECT 'Normal', CAST(count(*) * {SYNTHETIC_PCT} // 100 AS BIGINT), true FROM lineitem"""
ORACLE["clean_dirty"] = f"""
    SELECT l_orderkey, l_linenumber, l_partkey, {r6('CASE WHEN k > 3 THEN l_quantity ELSE 0 END')} AS l_quantity,
           {r6('CASE WHEN k <> 4 THEN l_tax ELSE 0 END')} AS l_tax,
           CASE WHEN k <> 5 THEN l_linestatus ELSE '0' END AS l_linestatus
    FROM (SELECT *, (l_orderkey + l_linenumber) % 7 AS k FROM lineitem)"""
ORACLE["align_columns"] = f"""
    SELECT l_orderkey, l_linenumber, {r6('l_quantity')} AS l_quantity, 0.0::DOUBLE AS l_discount,
           {r6('l_tax')} AS l_tax, '0' AS l_linestatus FROM lineitem"""
ORACLE["column_differences"] = """
    SELECT l_returnflag AS Label, CAST(count(*) AS BIGINT) AS rows,
           CASE l_returnflag WHEN 'A' THEN 'l_discount' WHEN 'N' THEN 'l_extendedprice' ELSE 'l_quantity' END AS missing,
           CASE l_returnflag WHEN 'N' THEN 'l_tax' ELSE '' END AS extra
    FROM lineitem GROUP BY l_returnflag"""
ORACLE["prep_values"] = """
    WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st,
                      avg((l_linestatus = 'O')::INT) AS mo, stddev_pop((l_linestatus = 'O')::INT) AS so FROM lineitem)
    SELECT l_orderkey, l_linenumber,
           CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INTEGER) AS label_idx,
           floor(CAST(CAST((l_quantity - mq) / sq AS FLOAT) AS DOUBLE) * 1e4 + 0.5) / 1e4 AS f0,
           floor(CAST(CAST((l_tax - mt) / st AS FLOAT) AS DOUBLE) * 1e4 + 0.5) / 1e4 AS f1,
           floor(CAST(CAST(((l_linestatus = 'O')::INT - mo) / so AS FLOAT) AS DOUBLE) * 1e4 + 0.5) / 1e4 AS f2
    FROM lineitem, s"""

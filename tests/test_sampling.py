"""Cuts, quotas and splits: any key, null groups, the same rows at every setting."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import sampling as S

SCHEMA = "g string, s string, x double, n int, id int"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(0)
    data = [(rng.choice(["a", "a", "a", "b", None]),
             rng.choice([None, "", "same prefix of more than twenty-eight bytes " + str(rng.random()),
                         "b" + str(rng.randint(0, 40)), "ß" + str(rng.random())]),
             rng.choice([None, float("nan"), float("inf"), -1.5, rng.gauss(0, 1), 1e300]),
             rng.choice([None, rng.randint(-9, 9), -2**31, 2**31 - 1]), k) for k in range(1500)]
    return spark.createDataFrame(data, SCHEMA).repartition(7).cache()


def _expr(text):
    return lambda: F.expr(text)


ORDERS = {
    "text": ["s", "id"], "text desc": [("s", "desc"), "id"], "double": ["x", "id"],
    "double desc": [("x", "desc"), "id"], "int": ["n", "id"], "int desc": [("n", "desc"), ("id", "desc")],
    "hash": [_expr("xxhash64(id)"), "id"], "constant": [_expr("1"), "id"],
    "array": [_expr("array(n)"), "id"], "int then text": ["n", "s", "id"],
    "date": [_expr("date_add(DATE'2024-01-01', n % 50)"), "id"],
    "timestamp desc": [(_expr("timestamp_seconds(n * 1000L)"), "desc"), "id"],
    "decimal": [_expr("CAST(n AS decimal(20, 3)) / 7"), "id"], "boolean": [_expr("n > 3"), "id"],
}


def made(order):
    out = []
    for item in order:
        c, way = item if isinstance(item, tuple) else (item, "asc")
        out.append((c() if callable(c) else c, way))
    return out


def expected(rows, order, n):
    from pyspark.sql import Window
    rank = F.row_number().over(Window.partitionBy("g").orderBy(*S._sorted_by(order)))
    return sorted(r["id"] for r in rows.withColumn("r", rank).filter(F.col("r") <= n).collect())


@pytest.mark.parametrize("order", ORDERS.values(), ids=ORDERS.keys())
def test_first_rows_are_the_same_at_every_setting(rows, order):
    order = made(order)
    want = expected(rows, order, 130)
    for per in (None, 1 << 20, 300, 20):
        got = S.first_n_per_group(rows, ["g"], order, 130, rows_per_range=per)
        assert sorted(r["id"] for r in got.collect()) == want, per
        assert got.columns == rows.columns


@pytest.mark.parametrize("n", [0, 1, 10_000])
def test_quotas_at_the_edges(rows, n):
    for per in (None, 50):
        got = S.first_n_per_group(rows, ["g"], ["id"], n, rows_per_range=per)
        assert sorted(r["id"] for r in got.collect()) == expected(rows, ["id"], n)


@pytest.mark.parametrize("per", [1 << 20, 100, 10])
def test_splits_hit_their_counts_and_a_null_class_is_split(rows, per):
    two = S.stratified_split(rows, "g", 20, [("s", "desc"), "id"], rows_per_range=per)
    three = S.three_way_split(rows, "g", ["x", "id"], rows_per_range=per)
    sizes = {r["g"]: r["count"] for r in rows.groupBy("g").count().collect()}
    got2 = {(r["g"], r["split"]): r["count"] for r in two.groupBy("g", "split").count().collect()}
    got3 = {(r["g"], r["split"]): r["count"] for r in three.groupBy("g", "split").count().collect()}
    for g, n in sizes.items():
        test = -(-n * 20 // 100)
        held = -(-(n - test) * 20 // 100)
        assert (got2[g, "test"], got2[g, "train"]) == (test, n - test)
        assert (got3[g, "test"], got3[g, "validation"], got3[g, "train"]) == (test, held, n - test - held)
    assert two.count() == three.count() == rows.count()


def test_split_does_not_depend_on_the_setting(rows):
    got = [sorted(tuple(r) for r in S.three_way_split(rows, "g", ["n", "id"], rows_per_range=per)
                  .select("id", "split").collect()) for per in (1 << 20, 64)]
    assert got[0] == got[1]


def test_plans(rows, spark, capsys):
    table = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    S.first_n_per_group(table, ["l_returnflag"], ["l_orderkey", "l_linenumber"], 100).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
    S.three_way_split(table, "l_returnflag", ["l_orderkey", "l_linenumber"], rows_per_range=200).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan parquet") <= 2 and "SortMergeJoin" not in plan


def test_too_many_large_groups(rows, monkeypatch):
    monkeypatch.setattr(S, "MAX_LARGE_GROUPS", 1)
    with pytest.raises(ValueError):
        S.stratified_split(rows, "g", order_cols=["id"], rows_per_range=10)


def test_empty_and_repeated_rows(rows):
    none = rows.limit(0)
    assert S.three_way_split(none, "g", ["id"]).collect() == []
    assert S.first_n_per_group(none, ["g"], ["id"], 5, rows_per_range=5).collect() == []
    twice = rows.unionAll(rows)
    got = S.first_n_per_group(twice, ["g"], ["id", "n"], 7, rows_per_range=5)
    assert got.count() == 21


def test_synthetic_rows_are_appended_once(spark):
    df = spark.createDataFrame([(1.0, 2, "A")], "x double, k int, Label string")
    out = S.with_synthetic_normal(df, {"x": (5.0, 1.0)}, 50)
    assert out.filter("Label = 'Normal'").count() == 50 and out.columns == df.columns
    assert abs(out.filter("Label = 'Normal'").agg(F.avg("x")).first()[0] - 5) < 1
    assert S.with_synthetic_normal(out, {"x": (5.0, 1.0)}, 50).count() == 51


def _open_rows(df, order, cuts, per):
    """The most rows of a group that one window ranks for a cut."""
    data, open_cols, _ = S._decided(df, ["g"], order, cuts, per)
    return max((r["count"] for c in open_cols for r in data.filter(c).groupBy("g").count().collect()), default=0)


@pytest.mark.parametrize("order", [
    [(_expr("concat(repeat('p', 40), id % 7)"), "desc"), "id"],
    [_expr("IF(id % 2 = 0, NULL, 'same')"), _expr("id % 3 / 10"), _expr("repeat('x', 300)"), ("id", "desc")],
    [_expr("CAST(id % 5 AS decimal(20, 3)) / 7"), "id"], [_expr("id + (1L << 60)")],
], ids=["long prefix", "ties in all columns but the last", "decimal", "neighbouring large digits"])
def test_few_rows_are_ranked_whatever_the_key(spark, order):
    order = made(order)
    df = spark.range(4000).select(F.lit(None).cast("string").alias("g"), F.col("id"))
    assert _open_rows(df, order, [lambda n: n // 5, lambda n: 0 * n + 1000], 64) <= 64
    got = S.first_n_per_group(df, ["g"], order, 1000, rows_per_range=64)
    assert sorted(r["id"] for r in got.collect()) == expected(df, order, 1000)


def test_a_cut_at_the_end_of_a_group_ranks_nothing(rows):
    cuts = [lambda n: n, lambda n: n + 5, lambda n: 0 * n]
    assert _open_rows(rows.filter("g = 'a'"), ["id"], cuts, 64) == 0
    out = S.below_cuts(rows, ["g"], ["id"], cuts, 64)
    assert out.filter("below_0 AND below_1 AND NOT below_2").count() == rows.count() == out.count()

"""Exact first rows per group, splits, samples and synthetic rows.

``row_number() over (partition by class order by key)`` over a whole table puts
a third of all rows into one task when one class holds them. A quota or a split
does not need every rank, only to know on which side of a cut position a row
falls. ``below_cuts`` finds that with counts:

1. one aggregation gives each group's size and the range of the order key;
2. for a group larger than ``rows_per_range``, the range around each cut is
   counted in ``RANGES`` parts and narrowed to the part in which the cut falls,
   until few rows are left in it. Only counts reach the driver, a few per cut;
3. rows below or above that part are decided by comparing keys, a narrow
   expression; only rows inside it (and those of smaller groups) are ranked, so
   what is shuffled and sorted is a sliver.

The key is compared as *digits*: order-preserving integers made from the order
columns, nulls first when ascending and last when descending as in a sort. Digits
may tie where the columns differ; where that leaves too many rows around a cut, the
search is made again with more digits of texts and those of further columns. The
ranking inside the sliver settles ties on the columns themselves. Groups and keys may be null; every expression is
deterministic, so a recomputed task decides alike. Order keys must be total (add
every column) so that ties cannot swap rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_RANGE = 1 << 20     # rows that are ranked around one cut, about
RANGES = 1024                # parts that a range is counted in at a time
TEXT_DIGITS = 4              # of a text, first; more where its values agree so far
SMALL_N = 100_000            # quotas up to this are plain limited windows
MAX_LARGE_GROUPS = 10_000    # groups above ROWS_PER_RANGE that are narrowed at once

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType,
             T.TimestampType)


def _pairs(order_cols) -> list[tuple[Column, bool]]:
    """(column, descending) of order items: a name, a Column, or (either, "desc")."""
    out = []
    for item in order_cols:
        item, way = item if isinstance(item, tuple) else (item, "asc")
        out.append((F.col(item) if isinstance(item, str) else item, way == "desc"))
    return out


def _sorted_by(order_cols) -> list[Column]:
    return [c.desc() if down else c.asc() for c, down in _pairs(order_cols)]


def _digits(df: DataFrame, order_cols, text_digits: int = TEXT_DIGITS, inexact: int = 1):
    """Longs whose lexicographic order agrees with the sort order (ties allowed), and the
    ends that the list may have in a group: (digits up to there, condition, bytes). Later
    digits count only in groups all of whose rows meet the condition, that is, where the
    digits so far tell the column's values exactly; bytes are the length of a text. The
    list ends with the ``inexact``-th column that may have such an end."""
    out, ends = [], []
    for c, down in _pairs(order_cols):
        kind = df.select(c.alias("k")).schema["k"].dataType
        told, size, after = None, F.lit(0), []
        if isinstance(kind, _INTEGERS):
            if isinstance(kind, T.DateType):
                parts = [F.unix_date(c)]
            elif isinstance(kind, T.TimestampType):
                parts = [F.unix_micros(c)]
            else:
                parts = [c]
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            def toward_zero(v):
                return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))
            x = c.cast("double")
            whole = toward_zero(F.when(F.isnan(x), F.lit(9e18)).otherwise(
                F.least(F.greatest(x, F.lit(-9e18)), F.lit(9e18))))
            rest = F.when(F.abs(x) < 9e15, x - toward_zero(x)).otherwise(0.0) * float(1 << 52)
            last = (rest - toward_zero(rest)) * float(1 << 52)
            parts = [whole, toward_zero(rest), toward_zero(last)]
            told = (F.abs(x) < 9e18) & (last == toward_zero(last))
            if isinstance(kind, T.DecimalType):
                told = told & (x.cast(kind) == c)
        elif isinstance(kind, T.StringType):
            # seven bytes a digit; the length tells texts apart that end in zero bytes
            text = F.rpad(F.hex(c.cast("binary")), 14 * text_digits, "0")
            parts = [F.conv(F.substring(text, 1 + 14 * k, 14), 16, 10) for k in range(text_digits)]
            size = F.octet_length(c)
            told, after = size <= 7 * text_digits, [size]
        else:
            break
        null = F.when(c.isNull(), 1 if down else 0).otherwise(0 if down else 1)
        parts, after = ([F.coalesce(p.cast("long"), F.lit(0).cast("long")) for p in some] for some in (parts, after))
        out += [null.cast("long"), *[F.bitwise_not(v) if down else v for v in parts]]
        if told is not None:
            ends.append((len(out), F.coalesce(told, F.lit(True)), size))
            if len(ends) == inexact:
                break
            out += [F.bitwise_not(v) if down else v for v in after]
    return out, ends


@dataclass
class _Cut:
    """The search for one cut of one large group: rows whose first digits equal
    ``prefix`` and whose next one lies in [low, high]; ``before`` rows sort lower."""
    group: tuple
    cut: int
    position: int
    bounds: list                      # (min, max) of every digit that counts in the group
    size: int                         # rows of the group
    rows: int                         # rows left
    before: int = 0
    prefix: list = field(default_factory=list)
    low: int = 0
    high: int = 0

    def settle(self):
        """Step over digits on which all rows left agree; False at the last digit."""
        while self.low == self.high:
            if len(self.prefix) + 1 == len(self.bounds):
                return False
            self.prefix.append(self.low)
            self.low, self.high = self.bounds[len(self.prefix)]
        return True


def _narrow(df, keys, active):
    """Count the parts of every active range; rows (group, cut, part, n, low, high)."""
    spark = df.sparkSession
    kinds = [df.schema[k] for k in keys]
    schema = T.StructType([T.StructField(f"__g{i}", f.dataType) for i, f in enumerate(kinds)]
                          + [T.StructField("__cut", T.IntegerType()),
                             T.StructField("__prefix", T.ArrayType(T.LongType())),
                             T.StructField("__low", T.LongType()),
                             T.StructField("__high", T.LongType()),
                             T.StructField("__step", T.LongType())])
    # in integers: as doubles, neighbouring large digits would be one
    states = spark.createDataFrame(
        [(*s.group, s.cut, s.prefix, s.low, s.high, (s.high - s.low) // RANGES + 1) for s in active], schema)
    on = F.slice("__d", F.lit(1), F.size("__prefix")) == F.col("__prefix")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__g{i}"))
    digit = F.element_at("__d", F.size("__prefix") + 1)
    # the states are a few rows per large group, so their side is the broadcast one
    hit = df.select(*keys, "__d").join(F.broadcast(states), on).withColumn("__x", digit).filter(
        F.col("__x").between(F.col("__low"), F.col("__high")))
    return hit.groupBy(*[f"__g{i}" for i in range(len(keys))], "__cut", F.expr("__x div __step").alias("__part")).agg(
        F.count(F.lit(1)).alias("n"), F.min("__x").alias("low"), F.max("__x").alias("high")).collect()


def _search(df: DataFrame, keys: list, digits: list, ends: list, cuts: list, rows_per_range: int):
    """(cuts of the large groups, narrowed as far as ``rows_per_range`` or the digits go;
    whether more digits may narrow one further; bytes of the longest text of these groups)."""
    data = df.withColumn("__d", F.array(*digits))
    sizes = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.min(F.col("__d")[i]).alias(f"__lo{i}") for i in range(len(digits))],
        *[F.max(F.col("__d")[i]).alias(f"__hi{i}") for i in range(len(digits))],
        *[F.bool_and(told).alias(f"__told{i}") for i, (_, told, _) in enumerate(ends)],
        *[F.max(size).alias(f"__size{i}") for i, (_, _, size) in enumerate(ends)])
    large = sizes.filter(F.col("__n") > rows_per_range).limit(MAX_LARGE_GROUPS + 1).collect()
    if len(large) > MAX_LARGE_GROUPS:
        raise ValueError(f"more than {MAX_LARGE_GROUPS} groups above {rows_per_range} rows: "
                         "raise rows_per_range")
    found, longest = [], 0
    for r in large:
        usable = next((n for i, (n, _, _) in enumerate(ends) if not r[f"__told{i}"]), len(digits))
        longest = max(longest, *[r[f"__size{i}"] or 0 for i in range(len(ends))], 0)
        bounds = [(r[f"__lo{i}"], r[f"__hi{i}"]) for i in range(usable)]
        for c, cut in enumerate(cuts):
            found.append(_Cut(tuple(r[k] for k in keys), c, int(cut(r["__n"])), bounds, r["__n"],
                              r["__n"], low=bounds[0][0], high=bounds[0][1]))
    active, stuck = [], False

    def go_on(s):
        nonlocal stuck
        more = s.settle()
        stuck = stuck or not more
        return more
    active = [s for s in found if 0 < s.position < s.rows and go_on(s)]
    while active:
        parts: dict = {}
        for r in _narrow(data, keys, active):
            group = tuple(r[f"__g{i}"] for i in range(len(keys)))
            parts.setdefault((group, r["__cut"]), []).append((r["low"], r["high"], r["n"]))
        still = []
        for s in active:
            for low, high, n in sorted(parts[s.group, s.cut]):
                if s.before + n >= s.position:
                    s.low, s.high, s.rows = low, high, n
                    break
                s.before += n
            if s.rows > rows_per_range and go_on(s):
                still.append(s)
        active = still
    return found, stuck, longest


def _decided(df: DataFrame, keys: list, order_cols: list, cuts: list, rows_per_range: int):
    """(``df`` with whether each cut is open on the row, that is, takes a rank to decide;
    these columns; the decision of each cut where it is not open)."""
    text_digits, inexact = TEXT_DIGITS, 1
    while True:
        digits, ends = _digits(df, order_cols, text_digits, inexact)
        digits = digits or [F.lit(0).cast("long")]
        found, stuck, longest = _search(df, keys, digits, ends, cuts, rows_per_range)
        deeper = min(4 * text_digits, max(text_digits, -(-longest // 7)))
        if not stuck or (deeper == text_digits and len(ends) < inexact):
            break
        text_digits, inexact = deeper, inexact + 1
    data = df.withColumn("__d", F.array(*digits))

    kinds = [df.schema[k] for k in keys]
    ends = T.StructType([T.StructField(f"__g{i}", f.dataType) for i, f in enumerate(kinds)]
                        + [T.StructField("__size", T.LongType())]
                        + [T.StructField(f"__{n}{c}", k) for c in range(len(cuts)) for n, k in (
                            ("pos", T.LongType()), ("before", T.LongType()),
                            ("from", T.ArrayType(T.LongType())), ("to", T.ArrayType(T.LongType())))])
    rows: dict = {}
    for s in found:
        rows.setdefault(s.group, [s.size])
        rows[s.group] += [s.position, s.before, [*s.prefix, s.low], [*s.prefix, s.high]]
    table = df.sparkSession.createDataFrame([(*g, *v) for g, v in rows.items()], ends)
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__g{i}"))
    data = data.join(F.broadcast(table), on, "left")       # at most MAX_LARGE_GROUPS rows
    open_cols, sure = [], []
    for c in range(len(cuts)):
        head = F.slice("__d", F.lit(1), F.size(f"__from{c}"))
        pos = F.col(f"__pos{c}")
        # null for a small group: every row of it is ranked; a cut at the end needs no rank
        side = F.when(pos <= 0, False).when(pos >= F.col("__size"), True).when(head < F.col(f"__from{c}"), True) \
            .when(head > F.col(f"__to{c}"), False)
        sure.append(side)
        open_cols.append(f"__open{c}")
        data = data.withColumn(open_cols[c], side.isNull())
    return data, open_cols, sure


def below_cuts(df: DataFrame, group_cols: list[str], order_cols: list, cuts: list,
               rows_per_range: int = ROWS_PER_RANGE, names: list[str] | None = None) -> DataFrame:
    """``df`` with a boolean column per cut: whether the row is among the first
    ``position`` rows of its group in the given order. ``cuts`` are functions of a
    group's size, on Python integers and on Columns alike."""
    keys = list(group_cols)
    names = names or [f"below_{i}" for i in range(len(cuts))]
    plain = df.columns
    data, open_cols, sure = _decided(df, keys, order_cols, cuts, rows_per_range)
    any_open = F.lit(False)
    for o in open_cols:
        any_open = any_open | F.col(o)
    settled = data.filter(~any_open).select(*plain, *[s.alias(n) for s, n in zip(sure, names)])
    ranked = data.filter(any_open)
    order = _sorted_by(order_cols)
    for c, cut in enumerate(cuts):
        rank = F.row_number().over(Window.partitionBy(*keys, open_cols[c]).orderBy(*order))
        # a small group is all here, and all open, so this counts it whole
        size = F.count(F.lit(1)).over(Window.partitionBy(*keys, open_cols[c]))
        limit = F.when(F.col(f"__pos{c}").isNull(), cut(size)).otherwise(
            F.col(f"__pos{c}") - F.col(f"__before{c}"))
        ranked = ranked.withColumn(f"__in{c}", rank <= limit)
    ranked = ranked.select(*plain, *[
        F.when(F.col(open_cols[c]), F.col(f"__in{c}")).otherwise(sure[c])
        .alias(names[c]) for c in range(len(cuts))])
    return settled.unionByName(ranked)


def first_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list,
                      n: int, rows_per_range: int | None = None) -> DataFrame:
    """The first ``n`` rows of each group in ``order_cols`` order.

    Small quotas are a limited window: the engine keeps ``n`` rows per group in
    each task before the shuffle. Larger ones (or a given ``rows_per_range``) go
    through ``below_cuts``; the rows are the same."""
    if n <= SMALL_N and rows_per_range is None:
        rank = F.row_number().over(Window.partitionBy(*group_cols).orderBy(*_sorted_by(order_cols)))
        return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")
    out = below_cuts(df, group_cols, order_cols, [lambda size: n],
                     rows_per_range or ROWS_PER_RANGE, ["__below"])
    return out.filter("__below").drop("__below")


def seeded_order(df: DataFrame, seed: int, exclude=()) -> Column:
    """A reproducible pseudo-random order key: 64-bit hash of the row and seed."""
    cols = [c for c in df.columns if c not in set(exclude)]
    return F.xxhash64(F.lit(seed), *cols)


def _percent(pct: int):
    """ceil(n * pct / 100) in integers, of an integer or a Column."""
    def part(n):
        if isinstance(n, Column):
            return F.floor((n * int(pct) + 99) / 100)
        return (n * int(pct) + 99) // 100
    return part


def stratified_split(df: DataFrame, label: str, test_pct: int = 20,
                     order_cols: list | None = None, seed: int = 42,
                     out: str = "split", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Exact stratified split (W4): per class, null included, the first
    ceil(n * pct / 100) rows of a seeded order are ``test``, the rest ``train``.
    ``sampleBy`` only approximates the counts; this hits them exactly."""
    order = order_cols if order_cols is not None else [seeded_order(df, seed), *df.columns]
    cut = below_cuts(df, [label], order, [_percent(test_pct)], rows_per_range, ["__test"])
    return cut.withColumn(out, F.when(F.col("__test"), "test").otherwise("train")).drop("__test")


def three_way_split(df: DataFrame, label: str, order_cols: list | None = None,
                    seed: int = 42, out: str = "split",
                    rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """80/20, then 80/20 of the 80 (W4): test 20%, validation 16%, train 64% of
    each class, as two cuts of one order."""
    order = order_cols if order_cols is not None else [seeded_order(df, seed), *df.columns]
    fifth = _percent(20)
    cut = below_cuts(df, [label], order, [fifth, lambda n: fifth(n) + fifth(n - fifth(n))],
                     rows_per_range, ["__test", "__held"])
    return cut.withColumn(out, F.when(F.col("__test"), "test").when(F.col("__held"), "validation")
                          .otherwise("train")).drop("__test", "__held")


def sample_per_group(df: DataFrame, group_cols: list[str], size: int,
                     seed: int = 42) -> DataFrame:
    """Up to ``size`` rows per group without replacement (M1), in a seeded
    random order."""
    order = [seeded_order(df, seed), *df.columns]
    return first_n_per_group(df, group_cols, order, size)


def synthetic_rows(spark, stats: dict[str, tuple[float, float]], n: int,
                   label_col: str = "Label", label: str = "Normal",
                   spread: float = 0.75, seed: int = 42,
                   num_partitions: int | None = None) -> DataFrame:
    """``n`` rows with each feature ~ N(mean, spread * std).

    ``stats`` is the one-row fit of ``prepare.feature_moments``. Rows are
    generated in parallel by ``spark.range``; ``randn`` is seeded per column.
    """
    base = spark.range(0, n, numPartitions=num_partitions) if num_partitions else spark.range(0, n)
    cols = [
        (F.randn(seed + i) * F.lit(spread * std) + F.lit(mean)).alias(name)
        for i, (name, (mean, std)) in enumerate(stats.items())
    ]
    return base.select(*cols, F.lit(label).alias(label_col))


def with_synthetic_normal(df: DataFrame, stats: dict[str, tuple[float, float]], n: int,
                          label_col: str = "Label", label: str = "Normal",
                          seed: int = 42) -> DataFrame:
    """``df`` with ``n`` synthetic rows of ``label`` appended, unless it has rows of
    that label already (U2); features without stats are null in them."""
    if not df.filter(F.col(label_col) == label).isEmpty():
        return df
    made = synthetic_rows(df.sparkSession, stats, n, label_col, label, seed=seed)
    made = made.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in made.columns
                         if c in df.columns])
    return df.unionByName(made, allowMissingColumns=True)

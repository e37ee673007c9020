"""Vector code compression by member-resident Lloyd rounds (operator 13).

A vector's integer components are cut into ``PARTS`` equal parts, and each part is
replaced by the index of the nearest entry in its position's codebook. The codebooks
are fitted by Lloyd rounds over *all* parts: a part is a member of the entry nearest to
it, and every member lies in the home of its (position, entry, salt). A home is a
partition of a written table, dealt out by hash. In a round

1. the owners (a task per home) add up their resident members, in place; only their
   sums travel, a row per entry and home, and become the new codebook;
2. the owners look for each resident's nearest new entry. Who keeps its entry stays
   where it is, in the file it is in; only the parts that change entry are shuffled,
   into a further written table of homes.

So the parts are dealt out once, and later shuffles shrink as the rounds settle. The
salt spreads the members of one entry over many homes, so a codebook entry (or a vector
that a third of all rows repeat) has as many owners as it needs. The codebooks
(positions x entries x part width) are the only thing the driver holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import int_matrix, small_side, table, written

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
SALTS = 32                    # homes of one entry, at least
HOME_ROWS = 1 << 18           # members of an entry in one home, about, at most
PARTITION_ROWS = 1 << 22      # members in one partition of homes, about, at most
LIMIT = 1 << 26               # components are cut off here, so that errors fit a long
TILE = 4096                   # parts whose distances are worked out together

MEMBER = "position int, entry int, salt int, part array<int>"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, *more) -> DataFrame:
    """(vec_id, v, seat, *more) of the rows that take part; ``seat`` numbers them."""
    fine = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c)
                    & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(vec_col, lambda c: F.least(F.greatest(
        F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-2.0 * LIMIT)), F.lit(2.0 * LIMIT))),
        F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    return vectors.filter(F.col(vec_col).isNotNull()).filter(fine).select(
        F.col(id_col).alias("vec_id"), whole.alias("v"),
        F.monotonically_increasing_id().alias("seat"), *more)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest of ``entries`` to each of ``parts`` by squared distance,
    ties to the lower index, and that distance. Exact."""
    which = np.empty(len(parts), dtype=np.int32)
    apart = np.empty(len(parts), dtype=np.int64)
    # sums of products below 2**53 are exact in doubles
    small = (max(np.abs(parts).max(initial=0), np.abs(entries).max(initial=0)) ** 2
             * 4 * max(1, parts.shape[1]) < 1 << 53)
    if small:
        turned, norms = entries.T.astype(np.float64), (entries ** 2).sum(axis=1)
    for at in range(0, len(parts), TILE):
        some = parts[at:at + TILE]
        if small:
            # |p - c|^2 without the part's own norm, which is the same for all entries
            best = (norms - 2.0 * (some.astype(np.float64) @ turned)).argmin(axis=1)
        else:
            best = sum((some[:, None, j] - entries[None, :, j]) ** 2
                       for j in range(parts.shape[1])).argmin(axis=1)
        which[at:at + TILE] = best
        apart[at:at + TILE] = ((some - entries[best]) ** 2).sum(axis=1)
    return which, apart


def _batch_parts(batch, column: str, width: int) -> np.ndarray:
    return int_matrix(batch.column(column), width)[:, :width]


def _nearest_home(position, parts, books) -> np.ndarray:
    """Nearest entry of each part in its position's codebook."""
    out = np.empty(len(parts), dtype=np.int32)
    for p in np.unique(position):
        at = np.flatnonzero(position == p)
        out[at] = nearest(parts[at], books[p])[0]
    return out


def _members(books: np.ndarray, salts: int):
    """Every part of every vector as a member of its nearest entry."""
    positions, _, width = books.shape

    def run(batches):
        for batch in batches:
            v = _batch_parts(batch, "v", positions * width)
            # spread neighbouring seats over all salts
            seat = batch.column("seat").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            salt = ((seat >> np.uint64(32)) % np.uint64(salts)).astype(np.int32)
            for p in range(positions):
                parts = np.ascontiguousarray(v[:, p * width:(p + 1) * width])
                yield _batch(np.full(len(parts), p, np.int32), nearest(parts, books[p])[0], salt, parts)
    return run


def _batch(position, entry, salt, parts) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(parts) + 1, dtype=np.int32) * parts.shape[1])
    return pa.RecordBatch.from_arrays(
        [pa.array(position, pa.int32()), pa.array(entry, pa.int32()), pa.array(salt, pa.int32()),
         pa.ListArray.from_arrays(offsets, pa.array(parts.astype(np.int32).ravel()))],
        names=["position", "entry", "salt", "part"])


def _residents(batches, width: int, since: list[np.ndarray]):
    """(position, entry, salt, parts) of the members still at home: those whose entry
    stayed the nearest in every codebook since they came."""
    for batch in batches:
        position, entry, salt = (batch.column(c).to_numpy() for c in ("position", "entry", "salt"))
        parts = _batch_parts(batch, "part", width)
        for books in since:
            stay = np.flatnonzero(_nearest_home(position, parts, books) == entry)
            position, entry, salt, parts = position[stay], entry[stay], salt[stay], parts[stay]
        yield position, entry, salt, parts


def _owner_sums(shape, since):
    """A home's members, added up by entry."""
    positions, entries, width = shape

    def run(batches):
        sums = np.zeros((positions * entries, width), dtype=np.int64)
        counts = np.zeros(positions * entries, dtype=np.int64)
        for position, entry, _, parts in _residents(batches, width, since):
            at = position.astype(np.int64) * entries + entry
            np.add.at(sums, at, parts)
            counts += np.bincount(at, minlength=len(counts))
        used = np.flatnonzero(counts)
        offsets = pa.array(np.arange(len(used) + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays(
            [pa.array((used // entries).astype(np.int32)), pa.array((used % entries).astype(np.int32)),
             pa.array(counts[used]), pa.ListArray.from_arrays(offsets, pa.array(sums[used].ravel()))],
            names=["position", "entry", "n", "sums"])
    return run


def _leavers(width, since, books):
    """Residents whose nearest entry changed, as members of their new home."""
    def run(batches):
        for position, entry, salt, parts in _residents(batches, width, since):
            now = _nearest_home(position, parts, books)
            go = np.flatnonzero(now != entry)
            yield _batch(position[go], now[go], salt[go], parts[go])
    return run


def _updated(books: np.ndarray, homes) -> np.ndarray:
    """The codebooks after an update from the resident members of ``homes``: pairs of a
    table of homes and the codebooks since its members came."""
    sums = None
    for home, since in homes:
        own = home.mapInArrow(_owner_sums(books.shape, since),
                              "position int, entry int, n long, sums array<long>")
        sums = own if sums is None else sums.unionAll(own)
    total = sums.groupBy("position", "entry").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(books.shape[2])])
    new = books.copy()
    for r in total.collect():                     # positions x entries at most
        new[r["position"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(books.shape[2])]
    return new


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
        salts: int = SALTS) -> np.ndarray:
    """Codebooks (position, entry, component) of ``quantised`` rows, which should be
    cheap to read again: a written table. They start as the parts of the ``entries``
    rows of smallest id (equal ids by their vectors, null ids last; all, if fewer)."""
    spark = rows.sparkSession
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("wide")).first()
    width = max(1, -(-(size["wide"] or 0) // parts))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    books = np.zeros((len(first), parts * width), dtype=np.int64)
    for row, r in zip(books, first):
        row[:len(r["v"])] = r["v"]
    books = np.ascontiguousarray(books.reshape(len(first), parts, width).transpose(1, 0, 2))
    if not size["n"]:
        return books
    salts = max(salts, -(-size["n"] // HOME_ROWS))
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                 -(-size["n"] * parts // PARTITION_ROWS))

    def settle(members: DataFrame, name: str) -> DataFrame:
        return written(members.repartition(spread, "position", "entry", "salt"), name)

    # (homes, codebooks since): a member of a table is at home while all agree on its entry
    homes = [(settle(rows.mapInArrow(_members(books, salts), MEMBER), "homes"), [])]
    for k in range(rounds):
        if k:
            moved = None
            for home, since in homes:
                go = home.mapInArrow(_leavers(width, since, books), MEMBER)
                moved = go if moved is None else moved.unionAll(go)
            moved = settle(moved, "moved")
            homes = [(home, [*since, books]) for home, since in homes] + [(moved, [])]
        books = _updated(books, homes)
    return books


def _encoded(books: np.ndarray):
    positions, _, width = books.shape

    def run(batches):
        for batch in batches:
            v = _batch_parts(batch, "v", positions * width)
            error = np.zeros(len(v), dtype=np.int64)
            codes = np.empty((len(v), positions), dtype=np.int64)
            for p in range(positions):
                codes[:, p], apart = nearest(np.ascontiguousarray(v[:, p * width:(p + 1) * width]), books[p])
                error += apart
            digits = 2 if books.shape[1] <= 256 else 4
            text = codes.astype(">u1" if digits == 2 else ">u2").tobytes().hex()
            step = positions * digits
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"),
                 pa.array([text[k:k + step] for k in range(0, step * len(v), step)], pa.string()),
                 pa.array(error)], names=["vec_id", "label", "code", "error"])
    return run


def books_text(books: np.ndarray) -> str:
    """All entries' components as decimals, by position, entry, place in the part."""
    return ",".join(str(int(c)) for c in books.ravel())


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
             label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(codes, codebooks). ``codes`` has a row per vector that takes part: vec_id, code
    (hex digits, two a part up to 256 entries, else four), error (its squared distances
    added up), label_error (the errors of all rows of its label, nulls together),
    codebooks_sha256.

    A vector that is null or holds null or non-finite components takes no part. Shorter
    vectors end in zeros, as do all where the length is no multiple of ``parts``;
    components beyond +-2**26 / 256 count as that. Rows with a null id and repeated rows
    have a row each and count each time. An empty table gives no rows. Other columns are
    not read. Names do not clash: only the three named columns are taken over."""
    rows = written(quantised(vectors, id_col, vec_col, F.col(label_col).alias("label")), "vectors")
    books = fit(rows, parts, entries, rounds)
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label")]
    # the final assignment: codes hang on a vector's own parts alone, so vectors stay put
    codes = written(rows.mapInArrow(_encoded(books), ", ".join([*kinds, "code string", "error long"])),
                    "codes")
    totals = written(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    totals = small_side(totals.withColumnRenamed("label", "of"))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return codes.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")), books


def query(spark, sf_dir):
    return compress(table(spark, sf_dir, "embeddings"))[0]


def _oracle() -> str:
    steps, width = [], "CAST(len(v) / %d AS BIGINT)" % PARTS
    steps.append(f"""v AS (
  SELECT row_number() OVER () AS rid, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
p AS (
  SELECT rid, vec_id, label, position, v[position * {width} + 1 : (position + 1) * {width}] AS part
  FROM v, (SELECT unnest(range({PARTS})) AS position)),
c0 AS (
  SELECT position, row_number() OVER (PARTITION BY position ORDER BY vec_id) - 1 AS entry, part AS c
  FROM p QUALIFY row_number() OVER (PARTITION BY position ORDER BY vec_id) <= {ENTRIES})""")
    for k in range(ROUNDS + 1):
        steps.append(f"""d{k} AS (
  SELECT rid, p.position, entry, list_sum(list_transform(list_zip(part, c), lambda z:
         (z[1] - z[2]) * (z[1] - z[2]))) AS apart
  FROM p JOIN c{k} AS c ON p.position = c.position),
a{k} AS (
  SELECT rid, position, arg_min(entry, apart * {ENTRIES} + entry) AS entry, min(apart) AS apart
  FROM d{k} GROUP BY rid, position)""")
        if k < ROUNDS:
            steps.append(f"""s{k} AS (
  SELECT position, entry, i, sum(part[i]) AS s, count(*) AS n
  FROM p JOIN a{k} USING (rid, position), (SELECT unnest(range(1, 1 + (SELECT max(len(part)) FROM p))) AS i)
  GROUP BY position, entry, i),
c{k + 1} AS (
  SELECT c.position, c.entry, coalesce(m.c, c.c) AS c FROM c{k} AS c LEFT JOIN (
    SELECT position, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
    FROM s{k} GROUP BY position, entry) AS m ON c.position = m.position AND c.entry = m.entry)""")
    steps.append(f"""e AS (
  SELECT rid, string_agg(format('{{:02x}}', entry), '' ORDER BY position) AS code,
         CAST(sum(apart) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY position, entry)) FROM c{ROUNDS})
         AS codebooks_sha256
FROM v JOIN e USING (rid)"""


ORACLE = {"op13_vector_codes": _oracle()}

QUERIES = {"op13_vector_codes": query}

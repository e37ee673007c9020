"""SimHash near-duplicates through deletion-variant signatures (operator 8).

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that
differ in at most three bits differ in at most one bit in one of the segments
(two bits or more in both would make four). So each distinct fingerprint is
indexed under, per segment, its exact value and its 32 variants with one bit
deleted; fingerprints meet under an equal key exactly when that segment differs
by one bit or none, and every meeting is verified on all 64 bits.

A bucket (one key) yields a spanning forest of its verified links, never all its
pairs; the forests of all buckets together have the same connected components
as all links. A bucket cannot hold more than the fingerprints with one of two
segment values, so large buckets are known from a count per segment value; such
a bucket is split into chunks, and every pair of chunks is one small bucket.

Components come from alternating large-star and small-star rounds, each written
to shared storage.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import document_batches, fresh, small_side, table, written

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
CHUNK = 1 << 15          # fingerprints that one bucket, or one chunk of a split bucket, holds


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """SimHash of the text's word shingles as a signed 64-bit integer.

    Words are runs of anything but ASCII white space, lower-cased on A-Z only;
    ``bytes`` does exactly both. No words (null, empty, blank): 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - width + 1, 1)
    last = ends[width - 1:].tolist() if len(words) >= width else [len(line)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last)),
                         dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row of ``docs``; other columns are not read."""
    document_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp"))


def spanning_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over fingerprints within ``max_bits`` bits.
    Each visited fingerprint is compared with those not yet reached only."""
    out, left = [], fps
    while left.size > 1:
        stack, left = [left[0]], left[1:]
        while stack and left.size:
            f = stack.pop()
            near = np.bitwise_count(left ^ f) <= max_bits
            if near.any():
                hit = left[near]
                left = left[~near]
                stack.extend(hit)
                out.extend((int(f), int(g)) for g in hit)
    return out


def _bucket_links(max_bits: int):
    """Per partition, sorted by (key, part, fp): the links of each bucket."""
    def emit(keys, parts, fps):
        cut = np.flatnonzero((keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])) + 1
        starts = np.concatenate(([0], cut))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        pair = starts[sizes == 2]
        a, b = fps[pair], fps[pair + 1]
        near = np.bitwise_count(a ^ b) <= max_bits
        links = list(zip(a[near].astype(np.int64).tolist(), b[near].astype(np.int64).tolist()))
        for s, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            f = np.unique(fps[s:s + m])
            pos = int(keys[s] >> 32) % 33
            if pos < 32:     # a deleted bit on which all agree: the exact key has these
                side = (f >> np.uint64(32 * (int(keys[s] >> 32) // 33) + pos)) & np.uint64(1)
                if side.min() == side.max():
                    continue
            links += [(np.uint64(x).astype(np.int64).item(), np.uint64(y).astype(np.int64).item())
                      for x, y in spanning_links(f, max_bits)]
        return pd.DataFrame({"a": [min(p) for p in links], "b": [max(p) for p in links]},
                            dtype="int64").drop_duplicates()

    def run(frames):
        held = None
        for pdf in frames:
            now = (pdf["key"].to_numpy(), pdf["part"].to_numpy(),
                   pdf["fp"].to_numpy().astype(np.uint64))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            keys, parts, fps = now
            if not len(keys):
                continue
            same = (keys == keys[-1]) & (parts == parts[-1])
            open_at = len(keys) - int(same.sum())      # the last bucket may go on
            if open_at:
                yield emit(keys[:open_at], parts[:open_at], fps[:open_at])
            held = (keys[open_at:], parts[open_at:], fps[open_at:])
        if held is not None and len(held[0]):
            yield emit(*held)
    return run


_VALUE = "(CASE WHEN div(i, 33) = 0 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END)"
_KEY = (f"shiftleft(CAST(i AS LONG), 32) | (CASE WHEN i % 33 = 32 THEN {_VALUE} "
        f"ELSE {_VALUE} & ~shiftleft(1L, i % 33) END)")


def links(distinct_fps: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of the distinct
    fingerprints ``fp`` within ``max_bits`` (at most 3) bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments serve at most three differing bits")
    fps = distinct_fps.select("fp")
    variants = fps.select("fp", F.explode(F.expr("sequence(0, 65)")).alias("i")) \
        .select("fp", F.expr(_KEY).alias("key"))
    crowded = fps.select("fp", F.explode(F.expr("array(0, 33)")).alias("i")) \
        .select("i", F.expr(_VALUE).alias("v")).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")) \
        .filter(F.col("n") > chunk // 2)
    hot = written(
        crowded.select(F.explode(F.expr("sequence(i, i + 32)")).alias("i"),
                       F.col("v"), F.col("n"))
        .select(F.expr("shiftleft(CAST(i AS LONG), 32) | (CASE WHEN i % 33 = 32 THEN v "
                       "ELSE v & ~shiftleft(1L, i % 33) END)").alias("key"), "n")
        .groupBy("key").agg(F.sum("n").alias("n"))
        .select("key", F.ceil((F.col("n") + chunk // 2) / F.lit(chunk // 2)).cast("int").alias("c")),
        "hot-buckets")
    if hot.isEmpty():
        dealt = variants.withColumn("part", F.lit(0))
    else:   # chunk pairs (x, y), x <= y, of a split bucket; one of them may be the row's own
        own = F.expr("CAST(pmod(xxhash64(fp), c) AS INT)")
        dealt = variants.join(hot, "key", "left").withColumn("own", own).withColumn(
            "part", F.explode(F.expr(
                "CASE WHEN c IS NULL THEN array(0) ELSE transform(sequence(0, c - 1), "
                "o -> least(own, o) * c + greatest(own, o)) END"))).select("fp", "key", "part")
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", "fp") \
        .mapInPandas(_bucket_links(max_bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for every node
    of the undirected ``edges`` (a, b). Large-star and small-star rounds until
    the written edges stop changing."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(sign) == mark or not sign[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = tuple(sign)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"),
                                                           F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.expr("array(struct(u AS u, m AS v), struct(v AS u, m AS v))")).alias("e")) \
            .select("e.u", "e.v").filter("u <> v").distinct()
        now = written(small, "edges")


def grouped(fps: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """``fps`` (a written table with ``doc_id`` and ``fp``) with ``root``, the smallest
    fingerprint of the row's component, and ``component_id``, its smallest id."""
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fps")
    roots = written(components(links(reps, max_bits, chunk)), "roots")
    linked = roots.join(reps.withColumnRenamed("fp", "node"), "node")
    ids = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = written(roots.join(ids, "root").select(F.col("node").alias("fp"), "root",
                                                   "component_id"), "components")
    ids = reps.join(found, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.coalesce("component_id", "least_id").alias("component_id"))
    return fps.join(ids, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id that is reached over links of
    ``max_bits`` bits or fewer, the row's own included. Null text: as empty,
    fingerprint 0. Null ids are kept and never become a component's id unless it
    has no other. Repeated rows come back as often. An empty table gives no rows.
    Only ``id_col`` and ``text_col`` are read."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    return grouped(fps, max_bits, chunk).select("doc_id", "fp", "root", "component_id")


DROP_ROWS = 2_000_000        # row numbers (16 bytes each) that are broadcast at most


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         max_bits: int = MAX_BITS, broadcast_rows: int = DROP_ROWS) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest id (nulls
    last, then by fingerprint). Of rows that repeat that id and fingerprint one
    stays. A null text is an empty one. An empty table gives no rows. All columns are
    carried along.

    Rows are numbered as the marked table is written, so a row is known by one long, and
    all is decided on (row, id, fingerprint). Texts are read once more, against the
    numbers of the rows to drop; these are broadcast up to ``broadcast_rows``, a counted
    bound, beyond which texts are shuffled by row number once."""
    fp, row = fresh(docs, "fp", "row")
    document_batches(docs.sparkSession)
    marked = written(docs.withColumn(fp, _fingerprints(F.col(text_col)))
                     .withColumn(row, F.monotonically_increasing_id()), "marked")
    pairs = written(marked.select(F.col(id_col).alias("doc_id"), F.col(fp).alias("fp"),
                                  F.col(row).alias("row")), "pairs")
    # the row to keep of each fingerprint, then of each component: joins meet one row
    # a fingerprint, however many rows share it
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    reps = written(pairs.groupBy("fp").agg(F.min(key).alias("k")), "distinct-fps")
    roots = written(components(links(reps, max_bits)), "roots").withColumnRenamed("node", "fp")
    stay = reps.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(
        F.min(F.struct("k.no_id", "k.doc_id", "fp", "k.row")).alias("k")).select("k.row")
    drop = written(pairs.select("row").join(stay, "row", "left_anti"), "near-copies")
    kept = marked.join(small_side(drop.withColumnRenamed("row", row), broadcast_rows), row, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


QUERIES = {"op8_simhash_near_dedup": query}

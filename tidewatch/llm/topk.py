"""Exact top-k inner-product search, term at a time (operator 6).

Vectors become sparse integer rows. A block of candidate rows is turned into
postings: per component, the rows with a weight there. For each component, the
queries that have a weight scatter ``query weight x posting weight`` into dense
score arrays (one per query, one slot per candidate row of the block). Each block
then selects its k best per query, a partition keeps a running k best, and the
partitions' lists are merged by a window. Every candidate meets every query.

Queries go in blocks of at most ``QUERY_BLOCK`` rows, each a broadcast of bounded
size and one pass over the candidates, which are never shuffled. A block's lists are
written before the next block is fetched, so the driver holds one block at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

SCALE = 64
K = 20
EVERY = 20                   # queries: ids divisible by this
QUERY_BLOCK = 1 << 14        # query rows in one broadcast
TILE_QUERIES, TILE_ROWS = 128, 2048


def quantised(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part: an id, a vector,
    and neither null nor non-finite components."""
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x)
                    & (F.abs(x.cast("double")) < float("inf")))
    return df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(fine).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vec_col, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of integer lists as a matrix; shorter rows end in zeros."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat[ends[0]:ends[-1]]
    return out


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products by scattering each component's postings. The type is the
    narrowest integer that holds every possible sum; beyond 64 bits it raises."""
    top = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * rows.shape[1]
    if top >= 1 << 62:
        raise OverflowError("inner products beyond 64 bits")
    kind = np.int32 if top < 1 << 31 else np.int64
    queries, rows = queries.astype(kind), np.ascontiguousarray(rows.T.astype(kind))
    out = np.zeros((len(queries), rows.shape[1]), dtype=kind)
    for weights, posting in zip(queries.T, rows):
        who, at = np.flatnonzero(weights), np.flatnonzero(posting)
        if not len(who) or not len(at):
            continue
        if 2 * len(at) > len(posting):         # a long posting is kept as a dense run
            add = np.multiply.outer(weights[who], posting)
            if len(who) == len(weights):
                out += add
            else:
                out[who] += add
        else:
            out[np.ix_(who, at)] += np.multiply.outer(weights[who], posting[at])
    return out


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row: highest score, then smallest id. A slot without a
    candidate has the lowest score there is."""
    if score.shape[1] > k:
        order = np.argsort(ids, axis=1) if ids.ndim == 2 else None
        if order is not None:
            score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        # ids ascend along a row, so equal scores are cut at the right place by
        # taking what is above the k-th score and then the first equal ones
        cut = -np.partition(-score, k - 1, axis=1)[:, k - 1:k]
        above = score > cut
        equal = score == cut
        room = k - above.sum(axis=1, keepdims=True)
        keep = above | (equal & (np.cumsum(equal, axis=1) <= room))
        at = np.nonzero(keep)[1].reshape(len(score), k)
        score = np.take_along_axis(score, at, 1)
        ids = np.take_along_axis(np.broadcast_to(ids, keep.shape), at, 1)
        return score, ids
    return score, np.broadcast_to(ids, score.shape)


def _search(query_ids: np.ndarray, queries: np.ndarray, k: int):
    none = np.int64(-(1 << 62))          # below every score

    def run(batches):
        held = [(np.empty((len(query_ids[q:q + TILE_QUERIES]), 0), dtype=np.int64),) * 2
                for q in range(0, len(query_ids), TILE_QUERIES)]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            rows = _matrix(batch.column(1), queries.shape[1])[order]
            ids = ids[order]
            wide = np.pad(queries, ((0, 0), (0, rows.shape[1] - queries.shape[1])))
            for r in range(0, len(ids), TILE_ROWS):
                some = ids[r:r + TILE_ROWS]
                for n, q in enumerate(range(0, len(query_ids), TILE_QUERIES)):
                    got = scores(wide[q:q + TILE_QUERIES], rows[r:r + TILE_ROWS])
                    own = query_ids[q:q + TILE_QUERIES, None] == some
                    if own.any():
                        got = np.where(own, none, got)
                    s, i = _best(got, some, k)
                    both = [np.concatenate((a, b.astype(np.int64)), axis=1)
                            for a, b in zip(held[n], (s, i))]
                    held[n] = _best(*both, k)
        for n, q in enumerate(range(0, len(query_ids), TILE_QUERIES)):
            s, i = held[n]
            at = np.repeat(np.arange(q, q + len(s)), s.shape[1])
            fine = s.ravel() != none
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[at][fine], pa.int64()), pa.array(at[fine], pa.int64()),
                 pa.array(i.ravel()[fine], pa.int64()), pa.array(s.ravel()[fine], pa.int64())],
                names=["query_id", "query_row", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id",
          vec_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for every query row, an id divisible by
    ``every``: its ``k`` best rows but those with its own id, ties to the smaller
    id. A vector that is null or holds null or non-finite components takes no
    part, nor does a row without an id; shorter vectors end in zeros. A repeated
    query row has its own list, a repeated candidate its own place. An empty
    table gives no rows. Other columns are not read."""
    rows = written(quantised(vectors, id_col, vec_col), "vectors")
    asked = written(rows.filter(F.col("vec_id") % every == 0), "queries")
    blocks = max(1, -(-asked.count() * 5 // (query_block * 4)))   # filled to four fifths
    found = None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()),
                                    F.lit(blocks)) == b).toArrow().combine_chunks()
        ids = block.column(0).to_numpy()
        column = block.column(1).combine_chunks()
        matrix = _matrix(column) if len(ids) else np.zeros((0, 0), dtype=np.int64)
        for at in range(0, max(len(ids), 1), query_block):
            part = rows.mapInArrow(_search(ids[at:at + query_block], matrix[at:at + query_block], k),
                                   "query_id long, query_row long, vec_id long, score long") \
                .withColumn("block", F.lit(f"{b}.{at}"))
            part = written(part, "found")
            found = part if found is None else found.unionAll(part)
    best = Window.partitionBy("block", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = {"op6_exact_top_k": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, CAST(score AS BIGINT) AS score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}"""}

QUERIES = {"op6_exact_top_k": query}

"""Best-fit packing of token sequences (operator 7).

A document is its byte-level BPE ids followed by the id 0. Documents longer than
a sequence are cut into pieces of the full length, the remainder first; no other
document is cut. Pieces are packed best-fit decreasing: longest first, each into
the open sequence with the least room that still holds it, which a segment tree
over room sizes finds in logarithmic time.

Tokenising is one narrow pass that writes a row per piece (lengths and checksums,
no ids). Pieces are then dealt round robin to shards of about ``SHARD`` pieces,
however large one document or source is, and each shard is packed by itself;
best-fit decreasing leaves at most a few part-filled sequences a shard.
"""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import document_batches, table, written

LENGTH = 2048
END_ID = 0
SHARD = 1 << 16
VOCABULARY = "byte_bpe_50k"
PIECE = T.StructType([T.StructField("piece", T.IntegerType()),
                      T.StructField("start", T.LongType()),
                      T.StructField("length", T.LongType()),
                      T.StructField("ids_crc32", T.LongType())])
_loaded: dict = {}


def tokenizer_paths(vocabulary: str = VOCABULARY) -> tuple[str, str]:
    """The vocabulary as a ``tokenizers`` file and as ``tiktoken`` ranks."""
    import public_tokenizers

    return public_tokenizers.path(f"{vocabulary}.json"), public_tokenizers.path(f"{vocabulary}.tiktoken")


def _full(path: str):
    """The ``tokenizers`` file, loaded when a text first needs it."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def encoder(paths: tuple[str, str]):
    """text -> ids. The ranks file holds the same vocabulary and merges and gives
    the same ids about four times as fast; texts that spell a special token go
    through the ``tokenizers`` file, which knows them. Loaded once a worker."""
    if paths not in _loaded:
        import public_tokenizers
        import tiktoken

        with open(paths[0], encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(paths[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN,
                                 mergeable_ranks=ranks, special_tokens={})

        def encode(text):
            if any(s in text for s in special):
                return _full(paths[0]).encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)
        _loaded[paths] = encode
    return _loaded[paths]


def cut(ids, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    data = np.asarray(ids, dtype="<u4")
    first = len(data) % length
    starts = [0, *range(first, len(data), length)] if first else list(range(0, len(data), length))
    ends = [*starts[1:], len(data)]
    return [(k, a, b - a, zlib.crc32(data[a:b].tobytes()))
            for k, (a, b) in enumerate(zip(starts, ends))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           length: int = LENGTH, paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), a row per piece. Every row of
    ``docs`` has at least one piece: a null or empty text is the end id alone."""
    document_batches(docs.sparkSession)
    paths = paths or tokenizer_paths()

    @F.pandas_udf(T.ArrayType(PIECE))
    def cut_texts(texts: pd.Series) -> pd.Series:
        encode = encoder(paths)
        names = PIECE.names
        return pd.Series([[dict(zip(names, p)) for p in cut([*encode(t or ""), END_ID], length)]
                          for t in texts], dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"),
                       F.explode(cut_texts(F.col(text_col))).alias("p")).select("doc_id", "p.*")


def best_fit(lengths: list[int], room: int = LENGTH) -> list[tuple[int, int]]:
    """(bin, offset) for each length, which must come in falling order.

    Leaf ``size + r`` of the tree counts the open bins with ``r`` left; an inner
    node sums its children. The tightest bin for a length is the first non-empty
    leaf at or right of it: climb while nothing is on the right, then descend."""
    size = 1 << room.bit_length()
    count = [0] * (2 * size)
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    out, made = [], 0

    def add(r, by):
        i = size + r
        while i:
            count[i] += by
            i >>= 1

    for n in lengths:
        if not 0 < n <= room:
            raise ValueError(f"a piece of {n} tokens for sequences of {room}")
        i = size + n
        if not count[i]:
            while i > 1 and not (i % 2 == 0 and count[i + 1]):
                i >>= 1
            if i > 1:
                i += 1
                while i < size:
                    i = 2 * i if count[2 * i] else 2 * i + 1
        if i > 1:
            left = i - size
            b = open_bins[left].pop()
            add(left, -1)
        else:
            left, b = room, made
            made += 1
        out.append((b, room - left))
        if left > n:
            open_bins[left - n].append(b)
            add(left - n, 1)
    return out


def pack(cut_pieces: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """``cut_pieces`` (a written table with a ``length`` column) with
    ``sequence_id`` and ``offset``. Equal pieces are told apart by row, so
    repeated rows are packed as often as they come. An empty table gives none."""
    shards = max(1, -(-cut_pieces.count() // shard))
    schema = T.StructType([*cut_pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def pack_shard(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        # Arrow, not pandas, so that null and large ids pass unchanged; ordering by
        # the row number makes a rerun of a lost task give the same sequences
        rows = rows.sort_by([("length", "descending"), ("__row", "ascending")])
        placed = best_fit(rows["length"].to_pylist(), length)
        base = key[0].as_py() << 32
        return rows.drop_columns(["__shard", "__row"]) \
            .append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64())) \
            .append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    dealt = cut_pieces.withColumn("__row", F.monotonically_increasing_id()) \
        .withColumn("__shard", F.col("__row") % shards)
    return dealt.groupBy("__shard").applyInArrow(pack_shard, schema)


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     length: int = LENGTH, shard: int = SHARD,
                     paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every
    piece of every row of ``docs``. Null and repeated ids are carried as they are."""
    found = written(pieces(docs, id_col, text_col, length, paths), "pieces")
    return pack(found, length, shard)


def query(spark, sf_dir):
    return best_fit_packing(table(spark, sf_dir, "documents"))


QUERIES = {"op7_best_fit_packing": query}

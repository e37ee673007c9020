"""Benchmark decontamination by size-partitioned MinHash containment (operator 5).

DataFrame and SQL functions only. A test item is the set of its five-word
shingles; a document contains it when it holds at least ``CONTAINMENT`` of that
set. Items are partitioned by set size (powers of two); an item of a partition
whose largest size is ``u`` is sketched by its ``floor((1 - c) * u) + 1`` smallest
shingle hashes, a bottom-k MinHash sketch as long as its partition needs. A
document that contains the item misses at most ``floor((1 - c) * n)`` of its ``n``
shingles, so at least one sketch hash is among the document's hashes: the search
loses nothing, which banded signatures of a short item against a long document
would. Candidates are verified on the shingle texts themselves.

Documents are never shuffled for the search: their hashes meet the sketches in a
join whose other side is a written table, broadcast only up to a counted size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shingles_sql, small_side, table, written

WIDTH = 5
CONTAINMENT = (8, 10)    # at least 8 of 10 of an item's distinct shingles

# Words are runs of letters and digits, lower-cased.
_WORDS = r"filter(split(lower(t), '[^\\p{L}\\p{N}]+'), w -> w <> '')"
_HASHES = shingles_sql(_WORDS, WIDTH, "xxhash64({s})")
_TEXTS = shingles_sql(_WORDS, WIDTH, "{s}")


def item_shingles(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, n, s, h, in_sketch): an item's distinct shingles and hashes."""
    per, of = CONTAINMENT
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("t")).select(
        "item_id", F.explode(F.expr(f"array_distinct({_TEXTS})")).alias("s")).distinct() \
        .withColumn("h", F.xxhash64("s"))
    sets = rows.groupBy("item_id").agg(F.countDistinct("s").alias("n"),
                                       F.array_sort(F.collect_set("h")).alias("hashes"))
    # the partition's largest size: 2^(floor(log2 n) + 1) - 1
    largest = F.expr("CAST(shiftleft(1L, length(bin(n))) - 1 AS LONG)")
    k = F.floor(largest * (of - per) / of).cast("int") + 1
    sets = sets.select("item_id", "n", F.slice("hashes", F.lit(1), k).alias("sketch"))
    return rows.alias("r").join(sets.alias("x"), F.expr("r.item_id <=> x.item_id")).select(
        "r.item_id", "n", "s", "h", F.array_contains("sketch", F.col("h")).alias("in_sketch"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, n_shingles, n_shared), a row per document text
    and item it contains. Documents are told apart by id and text, so null ids
    and repeated rows are judged each by its own text. A null or wordless text
    contains nothing and is contained in nothing; a text of fewer than five
    words is one shingle. Items with equal ids are one item. Empty tables give
    no rows. Other columns are not read."""
    per, of = CONTAINMENT
    shingles = written(item_shingles(items, item_col, item_text_col), "item-shingles")
    sketch = written(shingles.filter("in_sketch").select("h", "item_id").distinct(), "sketches")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"),
                       F.xxhash64(F.col(text_col)).alias("text_hash"))
    found = written(
        rows.select("doc_id", "text_hash", F.explode(F.expr(_HASHES)).alias("h"))
        .join(small_side(sketch), "h").select("doc_id", "text_hash", "item_id").distinct(), "candidates")
    suspects = small_side(written(found.select("doc_id", "text_hash").distinct(), "suspects"),
                          1_000_000)
    again = rows.alias("d").join(
        suspects.alias("f"), F.expr("d.text_hash = f.text_hash AND d.doc_id <=> f.doc_id"),
        "left_semi")
    shared = again.select("doc_id", "text_hash", F.explode(F.expr(_TEXTS)).alias("s")) \
        .join(small_side(shingles.select("item_id", "n", "s")), "s") \
        .groupBy("doc_id", "text_hash", "item_id", "n").agg(
            F.countDistinct("s").alias("n_shared"))
    return shared.alias("s").join(
        found.alias("f"), F.expr("s.text_hash = f.text_hash AND s.doc_id <=> f.doc_id "
                                 "AND s.item_id <=> f.item_id"), "left_semi") \
        .filter(F.col("n_shared") * of >= F.col("n") * per) \
        .select("doc_id", "text_hash", "item_id", F.col("n").alias("n_shingles"), "n_shared")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text contains an item."""
    hits = written(contaminated(docs, items, id_col, text_col)
                   .select("doc_id", "text_hash").distinct(), "contaminated")
    hits = small_side(hits, 1_000_000)
    return docs.join(hits, (F.xxhash64(docs[text_col]) == hits["text_hash"])
                     & docs[id_col].eqNullSafe(hits["doc_id"]), "left_anti")


def query(spark, sf_dir):
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared")


_SQL_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
ORACLE = {"op5_benchmark_decontamination": f"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, {_SQL_WORDS} AS w FROM documents
  UNION ALL SELECT 1, item_id, {_SQL_WORDS} FROM benchmark),
s AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
        FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n.n AS n_shingles, count(*) AS n_shared
FROM s d JOIN s b ON d.kind = 0 AND b.kind = 1 AND d.s = b.s JOIN n ON n.id = b.id
GROUP BY d.id, b.id, n.n HAVING count(*) * 10 >= n.n * 8"""}

QUERIES = {"op5_benchmark_decontamination": query}

"""A training corpus from crawled documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read back as the next one's docs. All but the last return the columns
of ``documents``: language identification drops what it rejects, near-duplicate
removal keeps one document of each group, decontamination drops documents that
contain a benchmark item, PII masks personal data in place. The last packs what
is left into token sequences.

Rows with null ids, null texts or repeated ids pass each stage by the rules in its
operator's docstring; further columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontaminate, language, packing, pii, simhash
from tidewatch.llm.common import fresh, table, written


# Below this score a text is not told apart from the languages that lost: an even vote
# over families and inside one gives 0.25, a text in a learned language mostly over 0.9.
MIN_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no learned language: null texts, texts without a letter, and
    those whose language is predicted with a score under ``MIN_SCORE``. Where no row has a
    usable language to learn from, every text with a letter stays."""
    lang, score = fresh(docs, "lang_pred", "score")
    model = language.fit(docs)
    if not model["families"]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    said = language.predict(docs, model, lang_out=lang, score_out=score)
    return said.filter((F.col(lang) != language.UNKNOWN) & (F.col(score) >= MIN_SCORE)) \
        .drop(lang, score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain an item of ``benchmark``."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; ``n_chars`` follows where texts change."""
    (new,) = fresh(docs, "masked")
    both = pii.mask(docs.withColumn(new, F.col("text")), new)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        both = both.withColumn("n_chars", F.when(F.col(new) != F.col("text"),
                                                 F.length(new).cast(kind)).otherwise(F.col("n_chars")))
    return both.withColumn("text", F.col(new)).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into token sequences: a row per piece."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii_deobfuscation", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

# Fingerprints, a classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = written(made.withColumns({c: F.col(f"`{c}`").cast("string")
                                         for c, kind in made.dtypes if kind == "void"}), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept: language,
quality, near duplicates, personal data, packing. All but the last return the columns of documents.
Null and empty texts have no language and go in the first stage; null ids, extra columns, repeated
rows and empty tables are handled as the operators say. Rows travel whole beside what a stage decides on,
so no column name clashes. The near-duplicate stage tells rows apart by id
and text, so rows without an id, or of one id with different texts, are in groups like others.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadfast.llm import langid, neardup, packing, pii, quality
from steadfast.llm.common import dealt, saved, table

#: A document of no known language, or with less than this share in its first one, is rejected.
LEAST_SHARE = 0.3
SIMILARITY_PCT = 80
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are mostly in one learned language."""
    found = langid.predicted(spark, langid.learn(docs))
    judged = docs.select(F.struct("*").alias("doc"), found("text").alias("found"))
    return judged.where((F.col("found.lang_pred") != langid.NONE) & (F.col("found.score") >= LEAST_SHARE)).select("doc.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier takes for good ones."""
    score = quality.scorer(docs, table(spark, sf_dir, "labels"))
    return docs.select(F.struct("*").alias("doc"), score("text").alias("score")).where(F.col("score") >= quality.THRESHOLD).select("doc.*")


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group, the one with the smallest id; of equal rows, one."""
    keys = neardup.kept_keys(docs, SIMILARITY_PCT)
    keyed = docs.select(F.struct("*").alias("doc"), neardup.row_key().alias("key"))
    return keyed.join(dealt(keys), "key", "left_semi").dropDuplicates(["key"]).select("doc.*")


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, RANKS)


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", no_near_duplicates),
    ("personal_data", no_personal_data),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

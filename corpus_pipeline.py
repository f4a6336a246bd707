"""A corpus pipeline over ``documents``: each stage reads what its predecessor kept.

Every stage reads the five columns of documents and no others, keeps rows with null and repeated ids apart, takes null
texts, and gives no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.io import cut_lineage, table
from tessera.llm import bpe, jaccard, language, mixing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores under 0.5; a null text is scored like an empty one, equal rows alike."""
    docs = docs.select(COLUMNS)
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(model) >= 0.5)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined (null texts and texts without letters too) or narrow; equal rows alike."""
    docs = docs.select(COLUMNS)
    content = language.train(docs)
    return docs.where(language.prediction_column(content)["accepted"])


def keep_one_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class of near copies, and every document without an id."""
    docs = docs.select(COLUMNS)
    row = ["doc_id", "text_hash"]
    first = jaccard.classes(docs).where("doc_id = class_id and text_hash = class_hash").select(row).distinct()
    kept = docs.withColumn("text_hash", F.xxhash64("text")).join(first, row, "left_semi").dropDuplicates(row)
    return kept.select(COLUMNS).unionAll(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources up to the limit; every document stays at least once.

    The rows of a block occur once in each epoch of the block, so equal or null ids do not change the copies.
    """
    docs = docs.select(COLUMNS)
    mixed = mixing.mix(docs, repetition_limit=mixing.REPEATS)
    copies = mixed.groupBy(F.col("source").alias("source_"), "block").agg(F.count_distinct("epoch").alias("copies"))
    placed = docs.withColumn("block", mixing.block_of(F.col("source"), F.col("doc_id")))
    return placed.join(copies, placed["source"].eqNullSafe(copies["source_"]) & (placed["block"] == copies["block"])).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each copy."""
    return bpe.token_digests(docs.select(COLUMNS), bpe.default_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("n-gram Jaccard join", keep_one_of_class),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]
#: The first stages are learned models; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Text preparation in five stages: language, near copies, repeated passages, mixture of sources, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the columns of documents.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulearn.llm import bpe, language_id, mixing, simhash, suffix_dedup
from tabulearn.llm.frames import crc_fold, table
from tabulearn.llm.queries import MIX_SEED, vocabulary
from tabulearn.session import ensure_checkpoint_dir

LEAST_SCORE = 0.35


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that no learned language explains."""
    net = language_id.fit(docs, crc_fold(F.col("doc_id"), 5) != 0)
    return language_id.accepted(docs, spark.sparkContext.broadcast(net), LEAST_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: fingerprints of four-word shingles that differ in at most four bits, as the operator's query has them."""
    return simhash.one_per_group(docs, words=4, distance=4, without_id_stay=False)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every string of 200 bytes that occurs twice; the number of characters follows."""
    return suffix_dedup.cleaned_rows(docs, span=200).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mixed_rows(docs, weights=(5, 2, 1), share=1.5, max_epochs=2.0, seed=MIX_SEED)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of their decoding."""
    return bpe.digests(docs, spark.sparkContext.broadcast(vocabulary()))


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", near_copies),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixture),
    ("bpe", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs

"""Corpus pipeline: language, exact copies, near copies, source mix, tokens.

Every stage takes the documents that the stage before kept, as a written table, and all but the last
return the columns of `documents`; the last returns the encoded corpus, a row per document of the mix.
"""
from pyspark.sql import DataFrame, SparkSession

from fleetsieve.llm import exact_dedup, language_id, mixing, piece_codec, simhash
from fleetsieve.session import scratch


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts in none of the languages learnt."""
    return language_id.known_language(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose fingerprints are linked, the smallest id stays."""
    return simhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, shard by shard."""
    return mixing.mixture(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, their number, and digests of them and of the text they decode to."""
    return piece_codec.encode_documents(docs, with_ids=True)


STAGES = [
    ("language ID", known_languages),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("mixing sources", mixed),
    ("SentencePiece encoding", encoded),
]
#: Trained models, 64-bit hashes and backtracking are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = scratch(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs

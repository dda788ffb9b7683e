"""The corpus pipeline: documents to training pieces, one operator a stage.

Each stage reads the table its predecessor wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorloom.llm import mixing, near_dedup, pieces, quality, secrets
from factorloom.llm.common import prepared, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    prepared(spark)
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least doc_id."""
    prepared(spark)
    return near_dedup.kept_documents(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; spans that the secret scan finds are replaced by a mark."""
    prepared(spark)
    return secrets.redacted_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights: documents as often as they are drawn."""
    prepared(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document of the mix."""
    prepared(spark)
    return pieces.encode_documents(docs, cache=PIECES)


#: Bytes of the pieces that a worker holds: less than by default, as the workers have served four stages before.
PIECES = 32 << 20

STAGES = [
    ("quality classifier", keep_good),
    ("minhash near-dedup", keep_one_of_each),
    ("secret scan", blank_secrets),
    ("source mixing", mix),
    ("piece encoding", encode),
]

#: The classifier's network and the piece transducer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)

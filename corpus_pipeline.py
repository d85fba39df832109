"""Corpus pipeline: quality, language, near-duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return rows with the columns of ``docs``. What a stage returns is written as
Parquet in the shared folder and read again as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquant.lineage import cut
from netquant.llm import langid, neardup, packing, pii, quality


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling towards those labelled good; the others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.resample(docs, labels).filter("selected").select(docs.columns)


def select_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a mixture of the learned languages explains better than noise; the others go."""
    model = langid.train(docs)
    return langid.identify(docs, model).filter(langid.accepted()).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    return neardup.drop_near_duplicates(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found personal data replaced by its kind."""
    return pii.redact(docs, pii.train(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 4096 tokens."""
    cuts = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack_full(cuts)


STAGES = [
    ("quality", select_quality),
    ("language", select_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Seeded hashing, expectation maximisation and tokenisers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs

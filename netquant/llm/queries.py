"""Registered queries of the dealt operators, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from netquant.lineage import cut
from netquant.llm import archives, bpe, counts, embeddings, fingerprints, langid, neardup, negatives, oracles, packing, phrases, pii, quality, toxicity
from netquant.llm.common import Registry, table

QUERIES = Registry()

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
CONTEXT_LIMITS = [2**k for k in range(9, 18)]


@QUERIES.add("op1_classifier_chain")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).drop("text")


@QUERIES.add("op2_bpe_tree_concat")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    digested = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), "ids")
    return bpe.decode(digested, BYTE_BPE).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


@QUERIES.add("op3_token_length_histogram")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = cut(counts.length_histogram(table(spark, sf_dir, "documents"), BYTE_BPE), "lengths")
    return counts.suffix_sums(histogram, CONTEXT_LIMITS)


@QUERIES.add("op7_nnls_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = packing.pieces(table(spark, sf_dir, "documents"), WORD_BPE)
    return packing.pack_full(cuts)


@QUERIES.add("op6_importance_resampling")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.resample(docs, table(spark, sf_dir, "labels")).drop("text")


@QUERIES.add("op9_language_mixture")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


@QUERIES.add("op10_locally_consistent_parsing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


@QUERIES.add("op4_candidate_boosting")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(pii.listed(spans, lambda s: s["base"]), 256)
    return found.select("doc_id", *map(count, pii.BASE), base.alias("base_sha256"), pii.listed(spans).alias("spans"))


@QUERIES.add("op5_subspace_pigeonhole")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@QUERIES.add("op8_weighted_minhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", F.col("first").alias("kept"))


@QUERIES.add("op11_str_packed_rtree", oracles.HARD_NEGATIVES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


@QUERIES.add("op12_multikey_quicksort", oracles.COLLOCATIONS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@QUERIES.add("op13_legacy_archive_converter", oracles.ARCHIVED_PAGES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archived_pages(table(spark, sf_dir, "pages"))


QUERIES.add("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

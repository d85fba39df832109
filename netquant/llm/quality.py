"""Quality selection by importance resampling.

Target text (labelled good) and raw text (every document) are each a multinomial over hashed word and word-pair buckets.
The log-ratio of the two is a document's log-weight; adding Gumbel noise and keeping the k largest draws k documents
without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquant.lineage import cut
from netquant.llm.common import byte_batches
from netquant.llm.features import chunks, labelled_sample, mixed, uniform, word_hashes
from netquant.operators import ranking

BATCH_BYTES = 8_000_000
SEED = 17


def ngram_buckets(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every word, sign run and neighbouring pair of them; case is kept."""
    word, doc = word_hashes(texts, signs=True)
    pair = mixed(word[:-1] * np.uint64(3) + word[1:])
    inside = doc[:-1] == doc[1:]
    codes = np.concatenate([word, pair[inside]])
    return (codes % np.uint64(buckets)).astype(np.int64), np.concatenate([doc, doc[:-1][inside]])


def log_ratios(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 16, bound: int = 50_000,
    prior: float = 20.0,
) -> tuple[np.ndarray, float]:
    """Log-ratio of target to raw for each bucket, and the share of good ones among the labels.

    ``labels``: ``(id_col, quality)``, 1 for target text. Raw counts cover every document; target counts those of at most ``bound``
    labelled ids, taken in hash order. Nulls count as no label and as empty text. Without target rows all ratios are 0.
    """
    sample = labelled_sample(labels.select(id_col, "quality").dropna(), id_col, bound)
    good = F.broadcast(sample.filter("quality = 1").select(F.col(id_col).alias("id"), F.lit(True).alias("target")))  # at most ``bound`` ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(good, "id", "left").select("text", "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            is_target = np.array(batch.column("target").fill_null(False).to_pylist(), bool)
            for first, part in chunks(batch.column("text").to_pylist()):
                bucket, doc = ngram_buckets(part, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[is_target[first + doc]], minlength=buckets)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    counted = rows.mapInArrow(run, "bucket long, raw long, target long")
    found = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # one row per bucket
    raw, target = np.ones(buckets), np.zeros(buckets)
    raw[found["bucket"]] += found["raw"]
    target[found["bucket"]] = found["target"]
    shares = sample.agg(F.avg((F.col("quality") == 1).cast("double")), F.count("*")).first()
    if not target.sum():
        return np.zeros(buckets), float(shares[0] or 1.0)
    # Both are smoothed by the same counts, so that a bucket seldom met says little either way.
    expected = raw / raw.sum() * target.sum()
    return np.log((target + prior) / (expected + prior)), float(shares[0])


def weigh(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``docs`` with ``log_weight`` and ``draw`` (log-weight plus Gumbel noise).

    The noise depends on id and text only, so repeated rows draw alike. Null and empty texts weigh 0. Columns of ``docs`` with these
    names are replaced, all others are kept.
    """
    names = [f.name for f in docs.schema.fields if f.name not in ("log_weight", "draw")]
    fields = [f for f in docs.schema.fields if f.name in names]
    sent = docs.sparkSession.sparkContext.broadcast(ratios)  # one number per bucket
    buckets = len(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in byte_batches(batches, text_col, BATCH_BYTES):
            weights = []
            for _, part in chunks(batch.column(text_col).to_pylist()):
                bucket, doc = ngram_buckets(part, buckets)
                weights.append(np.bincount(doc, table[bucket], minlength=len(part)).astype(float))
            new = pa.array(np.concatenate(weights) if weights else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), new], [*names, "log_weight"])

    schema = T.StructType([*fields, T.StructField("log_weight", T.DoubleType())])
    weighed = docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, schema)
    noise = -F.log(-F.log(uniform(seed, id_col, text_col)))
    return weighed.withColumn("draw", F.col("log_weight") + noise)


def threshold(draws: DataFrame, k: int) -> float | None:
    """The k-th largest ``draw``; rows that tie with it all count as drawn. Null if ``k`` is 0 or there are fewer rows."""
    counted = draws.groupBy((-F.col("draw")).alias("key")).agg(F.count("*").alias("n"))
    upto = ranking.running(ranking.sliced(counted, [], "key"), [], "key", F.col("n"), "sum", "upto")
    key = upto.filter(F.col("upto") >= k).agg(F.min("key")).first()[0] if k > 0 else None
    return None if key is None else -key


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """``docs`` with ``log_weight``, ``draw`` and ``selected``: Gumbel top-k over all rows.

    ``k``: how many to draw; by default the expected number of target documents, the sum over documents of
    min(1, share of good labels x weight). With ``k`` at or beyond the number of rows all are selected; an empty table gives
    an empty result.
    """
    ratios, share = log_ratios(docs, labels, id_col, text_col)
    rows = weigh(docs, ratios, id_col, text_col)
    draws = cut(rows.select("log_weight", "draw"), "draws")
    if k is None:
        log_share = float(np.log(max(share, 1e-9)))
        expected = F.sum(F.exp(F.least(F.lit(0.0), F.col("log_weight") + F.lit(log_share))))
        k = int(np.ceil(draws.agg(expected).first()[0] or 0))
    least = threshold(draws, k)
    return rows.withColumn("selected", F.col("draw") >= F.lit(least) if least is not None else F.lit(k > 0))

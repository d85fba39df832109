"""Token counts: the exact histogram of encoded lengths and its suffix sums.

Documents are counted by encoded length; suffix sums over the histogram then answer, for every context
limit, how many documents and tokens lie at or beyond it, the total left after truncation, and quantiles. The
histogram has at most one row per distinct length, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquant.llm.common import byte_batches, text_of
from netquant.llm.tokens import vocabulary
from netquant.operators import ranking

BATCH_BYTES = 8_000_000


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``(length, n_docs)``: documents by number of ids, no special token added.

    Null and empty texts have length 0, repeated rows count each time, other columns are ignored, an empty
    table gives an empty histogram. Each task sends a row per length it met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            ids = vocab.encode(batch.column("text").to_pylist())
            length, n = np.unique(np.fromiter(map(len, ids), np.int64, len(ids)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n.astype(np.int64))], ["length", "n"])

    counted = docs.select(text_of(text_col).alias("text")).mapInArrow(run, "length long, n long")
    return counted.groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame, limits: Sequence[int] = ()) -> DataFrame:
    """One row per length and extra limit, named ``context_limit``.

    ``n_docs`` and ``tokens`` at exactly this length; ``docs_from`` and ``tokens_from`` at it or beyond;
    ``docs_below`` and ``tokens_below``; ``truncated_tokens``: tokens left if every document is cut at the
    limit; ``dropped_tokens``: tokens that the cut loses; ``share_within``: documents that fit whole (0 to 1), the
    quantile this limit is. Extra limits without documents have ``n_docs`` 0. With an empty histogram and no limit the result is empty.
    """
    spark = histogram.sparkSession
    extra = spark.createDataFrame([(int(x), 0) for x in limits], "length long, n_docs long")
    known = histogram.select("length", "n_docs").union(extra).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    # Descending running sums are suffix sums: the helper sums upwards, so the key is negated.
    keyed = known.select((-F.col("length")).alias("key"), "length", "n_docs")
    slices = ranking.sliced(keyed, [], "key")
    docs = ranking.running(slices, [], "key", F.col("n_docs"), "sum", "docs_from")
    both = ranking.running(docs, [], "key", F.col("n_docs") * F.col("length"), "sum", "tokens_from")
    totals = slices.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.col("n_docs") * F.col("length")).alias("all_tokens"))
    tokens = F.col("n_docs") * F.col("length")
    kept = F.col("all_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")
    return ranking.with_totals(both, totals, []).select(
        F.col("length").alias("context_limit"),
        "n_docs",
        tokens.alias("tokens"),
        "docs_from",
        "tokens_from",
        (F.col("all_docs") - F.col("docs_from")).alias("docs_below"),
        (F.col("all_tokens") - F.col("tokens_from")).alias("tokens_below"),
        kept.alias("truncated_tokens"),
        (F.col("all_tokens") - kept).alias("dropped_tokens"),
        F.when(F.col("all_docs") > 0, (F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("share_within"),
    )


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """``(length)``: the least length within which at least ``share`` of the documents lie; null for an empty table."""
    return sums.filter((F.col("share_within") >= share) & (F.col("n_docs") > 0)).agg(F.min("context_limit").alias("length"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """``(tokens)`` left if every document is cut at ``limit``, which need not be a row of ``sums``."""
    # Below the first row at or beyond the limit nothing is cut; all documents from there on keep ``limit``.
    beyond = sums.filter(F.col("context_limit") >= limit).agg(F.max("docs_from").alias("d"), F.max("tokens_from").alias("t"))
    whole = sums.agg(F.sum("tokens").alias("all"))
    return whole.select(
        (F.col("all") - F.coalesce(beyond.select("t").scalar(), F.lit(0)) + limit * F.coalesce(beyond.select("d").scalar(), F.lit(0))).alias("tokens")
    )

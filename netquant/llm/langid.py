"""Language identification by mixture inference.

Each language is a multinomial over hashed letter trigrams. A document is a mixture of languages: expectation
maximisation estimates its proportions, nested sets of its strongest languages are fitted again, and the set with the best
likelihood less a penalty for each language is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquant.llm.common import byte_batches, text_of
from netquant.llm.features import chunks, letter_ngrams

BATCH_BYTES = 8_000_000
UNKNOWN = "und"
#: Fits end within this much of the greatest log-likelihood.
TOLERANCE = 1e-3


class Model(NamedTuple):
    languages: list[str]
    #: Log-probability, one row per bucket and one column per language: its size depends on the languages only.
    logs: np.ndarray


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 15, smoothing: float = 0.5) -> Model:
    """Trigram counts of every language over all documents with text and language.

    Each task sends a row per language and bucket; rows with null text or language are left out. Without any
    training row the model has no language. Memory: languages x buckets numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for first, part in chunks(batch.column("text").to_pylist()):
                bucket, doc = letter_ngrams(part, buckets)
                names, number = np.unique(langs[first : first + len(part)].astype(str), return_inverse=True)
                for k, name in enumerate(names):
                    here = np.bincount(bucket[number[doc] == k], minlength=buckets)
                    counts[name] = counts.get(name, 0) + here
        for name, count in counts.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(count[at])], ["lang", "bucket", "n"]
            )

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    counted = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    languages = sorted(found["lang"].unique().tolist())
    counts = np.zeros((buckets, len(languages)))
    place = {name: k for k, name in enumerate(languages)}
    counts[found["bucket"].to_numpy(np.int64), found["lang"].map(place).to_numpy(np.int64)] = found["n"]
    counts += smoothing
    return Model(languages, np.log(counts / counts.sum(0)).astype(np.float32))


SCHEMA = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("lang_set", T.ArrayType(T.StringType())),
    T.StructField("proportions", T.ArrayType(T.DoubleType())),
    T.StructField("fit", T.DoubleType()),
]


def identify(
    docs: DataFrame, model: Model, text_col: str = "text", penalty: float = 6.0, largest: int | None = None, rounds: int = 12
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``lang_set``, ``proportions`` and ``fit``.

    ``lang_set`` and ``proportions``: the chosen languages, strongest first; ``lang_pred`` and ``score`` are its first.
    ``fit``: mean log-likelihood per trigram above that of evenly spread trigrams; below 0 no language explains the text.
    ``penalty``: log-likelihood that each language of the set costs, times the log of the number of trigrams. Null text, text
    without letters, or a model without languages: ``und``, score 0, an empty set. ``largest``: most languages of a set, all if None;
    ``rounds``: steps between two tests of convergence. Columns of ``docs`` with these
    names are replaced; all others, repeated rows and nulls are kept.
    """
    added = [f.name for f in SCHEMA]
    kept = [f for f in docs.schema.fields if f.name not in added]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in byte_batches(batches, text_col, BATCH_BYTES):
            found = [infer(fitted, part, penalty, largest, rounds) for _, part in chunks(batch.column(text_col).to_pylist())]
            columns = [sum((list(f[k]) for f in found), []) for k in range(len(SCHEMA))]
            types = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.float64()]
            new = [pa.array(c, t) for c, t in zip(columns, types)]
            old = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*old, *new], [*(f.name for f in kept), *added])

    return docs.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, T.StructType([*kept, *SCHEMA]))


def fit(likely: np.ndarray, count: np.ndarray, runs: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages of ``likely`` by expectation maximisation from ``share``, and the log-likelihood of each text.

    ``likely``: a row per language, a column per trigram; ``runs``: trigrams of each text. Steps go on until no proportions can have a
    log-likelihood that is higher by more than ``TOLERANCE``: as it is concave, the largest growth of a proportion bounds the rest.
    """
    out, value, at = share.copy(), np.zeros(share.shape[1]), np.arange(share.shape[1])
    steps = rounds if len(share) > 1 else 1  # a single language keeps all of its text
    while len(at):
        first = np.cumsum(runs) - runs
        n = np.add.reduceat(count, first)
        for _ in range(steps):
            before = share
            part = likely * np.repeat(before, runs, axis=1)
            mix = np.maximum(part.sum(0), 1e-300)
            part *= count / mix
            share = np.add.reduceat(part, first, axis=1) / n
        del part
        growth = np.divide(share, before, out=np.zeros_like(share), where=before > 0).max(0)
        going = n * (growth - 1) > TOLERANCE
        done = ~going
        out[:, at[done]] = before[:, done]
        value[at[done]] = np.add.reduceat(count * np.log(mix), first)[done]
        row = np.repeat(going, runs)
        likely, count, runs, share, at = likely[:, row], count[row], runs[going], share[:, going], at[going]
    return out, value


def infer(model: Model, texts: list[str], penalty: float, largest: int | None, rounds: int):
    """Columns of :data:`SCHEMA` for a list of texts.

    Sets grow as long as a larger one can still win: none has more than the likelihood of all languages together, less its penalty.
    """
    languages, (buckets, k) = model.languages, model.logs.shape
    bucket, doc = letter_ngrams(texts, buckets)
    total = np.bincount(doc, minlength=len(texts)).astype(float)
    if not k or not len(bucket):
        empty = [[] for _ in texts]
        return [UNKNOWN] * len(texts), [0.0] * len(texts), empty, empty, [0.0] * len(texts)
    key, count = np.unique(doc.astype(np.int64) * buckets + bucket, return_counts=True)
    row, logs = key // buckets, model.logs[key % buckets]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    here = row[first]  # texts with trigrams
    runs = np.diff(np.append(first, len(row)))
    count, n = count.astype(np.float64), total[here]
    shift = logs.max(1)
    # One contiguous row per language.
    likely = np.exp(np.ascontiguousarray((logs - shift[:, None]).T, np.float64))
    base = np.add.reduceat(count * shift, first)

    whole_share, whole_value = fit(likely, count, runs, np.full((k, len(here)), 1.0 / k), rounds)
    order = np.argsort(-whole_share, axis=0, kind="stable")
    cost, most = penalty * np.log(n + 1), min(largest or k, k)
    best, best_share = np.full(len(here), -np.inf), np.zeros((k, len(here)))
    chosen = np.ones(len(here), np.int64)
    fitted = np.zeros(len(here))
    open_ = np.ones(len(here), bool)  # texts whose set may still grow
    for size in range(1, most + 1):
        at, row = np.flatnonzero(open_), np.repeat(open_, runs)
        strongest = order[:size, at]
        if size == k:
            among, value = np.take_along_axis(whole_share[:, at], strongest, axis=0), whole_value[at]
        else:
            part = np.take_along_axis(likely[:, row], np.repeat(strongest, runs[at], axis=1), axis=0)
            among, value = fit(part, count[row], runs[at], np.full((size, len(at)), 1.0 / size), rounds)
        now = np.zeros((k, len(at)))
        np.put_along_axis(now, strongest, among, axis=0)
        worth = value - size * cost[at]
        better = worth > best[at]
        won = at[better]
        best[won], best_share[:, won], chosen[won], fitted[won] = worth[better], now[:, better], size, value[better]
        open_ = whole_value + TOLERANCE - np.minimum((size + 1) * cost, most * cost) > best
        if not open_.any():
            break
    fitted += base
    best_share = best_share.T
    ranks = np.argsort(-best_share, axis=1, kind="stable")
    pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    sets: list[list[str]] = [[] for _ in texts]
    shares: list[list[float]] = [[] for _ in texts]
    above = [0.0] * len(texts)
    for i, at in enumerate(here.tolist()):
        top = ranks[i, : chosen[i]]
        sets[at] = [languages[j] for j in top]
        shares[at] = [float(min(1.0, best_share[i, j])) for j in top]
        pred[at], score[at] = sets[at][0], shares[at][0]
        above[at] = float(fitted[i] / n[i] + np.log(buckets))
    return pred, score, sets, shares, above


def held_out(id_col: str) -> Column:
    """Every fourth document by the checksum of its id as text; a null id is in neither part."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted() -> Column:
    """Rows of :func:`identify` that are written in a language: a learned one that explains the text better than noise."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("fit") > 0)


def predictions(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, held_out, lang_pred, score)`` with a model learned from the documents that are not held out."""
    model = train(docs.filter(~held_out(id_col) & F.col(id_col).isNotNull()))
    rows = docs.select(id_col, text_of("text").alias("text"), held_out(id_col).alias("held_out"))
    return identify(rows, model).select(id_col, "held_out", "lang_pred", "score")

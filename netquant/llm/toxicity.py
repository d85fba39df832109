"""Toxicity by classifier chains.

Categories are predicted one after another; each linear model sees the words and the probabilities of the categories before it. In
training those probabilities are out-of-fold predictions, so that later models learn from what they will meet in use.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquant.llm.common import byte_batches
from netquant.llm.features import chunks, labelled_sample, word_hashes

BATCH_BYTES = 8_000_000
#: Lengths of word beginnings that count as words of their own.
STEMS = (5, 7)


class Chain(NamedTuple):
    categories: list[str]
    #: Sorted hashes of the words used as features.
    words: np.ndarray
    #: For each category: weights of the words, of the earlier probabilities, and the constant.
    weights: list[np.ndarray]
    #: Probability of the last category from which a text is flagged.
    limit: float


def word_counts(texts: list[str], words: np.ndarray) -> np.ndarray:
    """Damped counts of the feature words in every text, one row per text."""
    out = np.zeros((len(texts), len(words)), np.float32)
    for first, part in chunks(texts):
        word, doc = word_hashes([t.lower() for t in part], False, STEMS)
        if len(words) and len(word):
            at = np.minimum(np.searchsorted(words, word), len(words) - 1)
            hit = words[at] == word
            np.add.at(out, (first + doc[hit], at[hit]), 1)
    return np.log1p(out)


def telling_words(rows: DataFrame, label: str, features: int, least: int) -> DataFrame:
    """``(word, odds)``: words of at least ``least`` positive documents with the largest log-odds for ``label``, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            flags = np.array(batch.column(label).to_pylist(), np.int64)
            for first, part in chunks(batch.column("text").to_pylist()):
                word, doc = word_hashes([t.lower() for t in part], False, STEMS)
                pairs = np.unique(np.stack([word.view(np.int64), doc.astype(np.int64)], 1), axis=0)
                unique, at = np.unique(pairs[:, 0], return_inverse=True)
                hits = np.bincount(at, flags[first + pairs[:, 1]], minlength=len(unique)).astype(np.int64)
                every = np.bincount(at, minlength=len(unique))
                yield pa.RecordBatch.from_arrays([pa.array(unique), pa.array(hits), pa.array(every - hits)], ["word", "pos", "neg"])

    counted = rows.select("text", label).mapInArrow(run, "word long, pos long, neg long")
    total = rows.agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    words = counted.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter(F.col("pos") >= least)
    all_pos, all_neg = total.select("pos").scalar(), total.select("neg").scalar()
    odds = F.log((F.col("pos") + 0.5) / (all_pos + 1)) - F.log((F.col("neg") + 0.5) / (all_neg + 1))
    return words.select("word", odds.alias("odds"), F.log(F.col("pos")).alias("size")).orderBy(
        (F.col("odds") * F.col("size")).desc(), "word"
    ).limit(features)


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights and constant of a ridge logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = predict(x[:, :-1], w)
        gradient = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -40, 40)))


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, folds: int) -> tuple[list[np.ndarray], float]:
    """One linear model per column of ``labels``; earlier categories enter as out-of-fold probabilities.

    Also the limit that gives the last category its best F1 on the out-of-fold probabilities.
    """
    weights, inputs, limit = [], x, 2.0  # without a positive row nothing is flagged
    for k in range(labels.shape[1]):
        y = labels[:, k]
        weights.append(fit_linear(inputs, y))
        outside = np.zeros(len(y))
        for f in range(folds):
            if (fold == f).any():
                outside[fold == f] = predict(inputs[fold == f], fit_linear(inputs[fold != f], y[fold != f]))
        inputs = np.hstack([inputs, outside[:, None]])
        if k == labels.shape[1] - 1 and y.any():
            limit = best_limit(outside, y)
    return weights, limit


def best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap below the probability that maximises F1."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = -1  # a limit can't part ties
    best = int(f1.argmax())
    below = p[order][best + 1] if best + 1 < len(y) else 0.0
    return float((p[order][best] + below) / 2)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
    levels: Sequence[int] = (2, 4),
    bound: int = 20_000,
    features: int = 128,
    folds: int = 5,
) -> Chain:
    """A chain over graded categories of ``label``, the strongest first, and ``label`` itself as the last link, which decides.

    Labels with one column only are graded by their own telling words: category ``label_n`` holds the labelled documents with at
    least n of them, for each n of ``levels``; its probability is an input of all links after it. At most ``bound`` labelled ids are used, in hash order; null labels, ids and texts
    are left out. Without a positive document every probability is near 0.
    """
    sample = F.broadcast(labelled_sample(labels.select(id_col, label).dropna(), id_col, bound))  # at most ``bound`` rows
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).dropna().join(sample, id_col)
    found = telling_words(rows, label, features, least=5).collect()  # at most ``features`` rows
    words = np.sort(np.array([r["word"] for r in found], np.int64).view(np.uint64))
    strong = np.array([r["word"] for r in found if r["odds"] > 3], np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            counts = word_counts(batch.column("text").to_pylist(), words)
            arrays = [batch.column("fold"), batch.column(label), pa.array([c.tobytes() for c in counts], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["fold", label, "counts"])

    folded = rows.select(F.pmod(F.xxhash64(F.lit(7), id_col), F.lit(folds)).cast("int").alias("fold"), F.col(label).cast("int").alias(label), "text")
    got = folded.mapInArrow(run, f"fold int, {label} int, counts binary").toPandas()  # bound x features numbers
    x = np.frombuffer(b"".join(got["counts"]), np.float32).reshape(len(got), len(words))
    y = got[label].to_numpy(np.float64)
    hits = np.expm1(x[:, np.isin(words, strong)]).sum(1)
    steps = sorted(levels, reverse=True)
    graded = np.stack([*(y * (hits >= n - 0.5) for n in steps), y], 1)
    return Chain([*(f"{label}_{n}" for n in steps), label], words, *fit_chain(x, graded, got["fold"].to_numpy(), folds))


def score(docs: DataFrame, chain: Chain, text_col: str = "text", limit: float | None = None) -> DataFrame:
    """``docs`` with ``p_<category>`` for each category and ``flagged``: whether the last one reaches ``limit`` (by default the
    chain's own, chosen on out-of-fold probabilities).

    Null and empty texts get the probabilities of a text without any feature word. Columns of ``docs`` with these names are
    replaced; all others and repeated rows are kept.
    """
    new = [*(f"p_{c}" for c in chain.categories), "flagged"]
    fields = [f for f in docs.schema.fields if f.name not in new]
    names = [f.name for f in fields]
    limit = chain.limit if limit is None else limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, text_col, BATCH_BYTES):
            inputs = word_counts([t or "" for t in batch.column(text_col).to_pylist()], chain.words)
            probabilities = []
            for w in chain.weights:
                probabilities.append(predict(inputs, w))
                inputs = np.hstack([inputs, probabilities[-1][:, None]])
            columns = [*map(pa.array, probabilities), pa.array(probabilities[-1] >= limit)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], [*names, *new])

    added = [*(T.StructField(n, T.DoubleType()) for n in new[:-1]), T.StructField("flagged", T.BooleanType())]
    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, T.StructType([*fields, *added]))

"""Vectorised words and letter n-grams of text batches, as arrays over all texts of a batch."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquant.llm.tokens import BLANK, LETTER, NUMBER, SPACE, classes

#: Code points handled at once.
CHUNK = 2_000_000


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """First place and texts of runs of about ``CHUNK`` code points; null counts as empty."""
    first, held, part = 0, 0, []
    for at, text in enumerate(texts):
        part.append(text or "")
        held += len(part[-1])
        if held >= CHUNK:
            yield first, part
            first, held, part = at + 1, 0, []
    if part:
        yield first, part


def word_hashes(texts: list[str], signs: bool, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and text number of every word: runs of letters and digits, with ``signs`` also of other signs.

    ``stems``: the first n letters of longer words follow as words of their own, marked by a hyphen.
    """
    joined = " ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind = classes()[points]
    run = np.where((kind == LETTER) | (kind == NUMBER), 1, np.where((kind == SPACE) | (kind == BLANK), 2, 0)).astype(np.uint8)
    at = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    wanted = run[at] == 1
    if signs:
        wanted |= run[at] == 0
    width = np.ones(len(points), np.uint8)
    if not joined.isascii():
        for limit in (0x80, 0x800, 0x10000):
            width += points >= limit
    byte_at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    offsets = byte_at[np.append(at, len(points))].astype(np.int32)
    data = joined.encode("utf-8", "surrogatepass")
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = pieces.filter(pa.array(wanted)).dictionary_encode()
    unique = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, unique), np.uint64, len(unique))
    index = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.searchsorted(ends, at[wanted])
    if not len(unique):
        return np.empty(0, np.uint64), doc
    words, docs = [hashes[index]], [doc]
    for n in stems:
        cut = [word.decode("utf-8", "replace") for word in unique]
        longer = np.fromiter((len(w) > n for w in cut), bool, len(cut))
        stem = np.fromiter((xxhash.xxh3_64_intdigest(w[:n] + "-") for w in cut), np.uint64, len(cut))
        keep = longer[index]
        words.append(stem[index][keep])
        docs.append(doc[keep])
    return np.concatenate(words), np.concatenate(docs)


def plain_word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and text number of every run of letters and digits, by array operations on code points only.

    A word's hash is the sum of its mixed code points times the powers of an odd number, mixed again.
    """
    joined = " ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind = classes()[points]
    inside = (kind == LETTER) | (kind == NUMBER)
    at = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))
    size = np.diff(np.append(at, len(points)))
    wanted = inside[at]
    power = np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    value = mixed(points + np.uint64(0x632BE59BD9B4E019))
    value *= power[np.arange(len(points)) - np.repeat(at, size)]
    return mixed(np.add.reduceat(value, at)[wanted] + size[wanted].astype(np.uint64)), np.searchsorted(ends, at[wanted])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal values stay equal, others spread."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=1)
def lower_letters() -> np.ndarray:
    """Lower-case code point of every letter below 0x3000 and the blank for every sign that is no letter."""
    points = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x3000):
        low = chr(c).lower()
        points[c] = ord(low) if len(low) == 1 else c
    points[classes() != LETTER] = 32
    return points


def letter_ngrams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every trigram of letters; one blank stands before, between and after words, so that each letter is in a trigram."""
    joined = " " + "   ".join(texts) + "  "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = lower_letters()[points]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)) + 3)
    kept = np.ones(len(letters), bool)
    kept[1:] = (letters[1:] != 32) | (letters[:-1] != 32) | (doc[1:] != doc[:-1])
    letters, doc = letters[kept].astype(np.uint64), doc[kept]
    if len(letters) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    code = mixed((a << np.uint64(42)) ^ (b << np.uint64(21)) ^ c)
    inside = (doc[:-2] == doc[2:]) & ((a != 32) | (b != 32)) & ((b != 32) | (c != 32))
    return (code[inside] % np.uint64(buckets)).astype(np.int64), doc[:-2][inside]


def uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) that depends on the columns only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def labelled_sample(labels: DataFrame, id_col: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids in hash order, one row per id; small enough to be sent to every task by its bound."""
    one = labels.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    return one.orderBy(F.xxhash64(id_col), id_col).limit(bound)

"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases by deterministic coin tossing: neighbouring symbols are compared bit by bit until a handful
of labels is left, phrases begin at the local maxima of the labels, and a phrase's name is a hash of its symbols. Names are
parsed again, level by level. A phrase's bounds depend on a few symbols around it only, so equal substrings have the same inner
names wherever they stand. The fingerprint is the k least hashes of the names from ``LEVEL`` up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquant.llm.common import byte_batches, text_of
from netquant.llm.features import mixed

BATCH_BYTES = 4_000_000
#: First level whose names count, for texts of all sizes, and how many hashes are kept. Names of level 1 are two or three code points long, which
#: unrelated texts share.
LEVEL, KEPT = 2, 64
#: Rows of one range of ids, and the most ranges: their bounds are sent to every task.
RANGE_ROWS, RANGES = 4_000, 20_000


def _toss(wide: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Label of each symbol: twice the lowest bit in which it differs from the one before, plus that bit."""
    before = np.empty_like(wide)
    before[1:] = wide[:-1]
    before[first] = wide[first] ^ wide.dtype.type(1)
    differ = wide ^ before
    lowest = differ & (~differ + wide.dtype.type(1))
    place = np.bitwise_count(lowest - wide.dtype.type(1))
    return 2 * place + ((wide & lowest) != 0)


def _toss_table(labels: int) -> np.ndarray:
    """The same for small labels, as a table of (label, label before)."""
    a, b = np.meshgrid(np.arange(labels, dtype=np.uint16), np.arange(labels, dtype=np.uint16), indexing="ij")
    differ = a ^ b
    lowest = differ & (~differ + np.uint16(1))
    table = 2 * np.bitwise_count(lowest - np.uint16(1)) + ((a & lowest) != 0)
    return np.where(differ == 0, 0, table).astype(np.uint8).ravel()


_TABLE = _toss_table(128)


def parse(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of all texts, and where each text begins in them.

    ``first``: where each text begins; every text has a symbol. A run of one symbol becomes a symbol of its own first.
    """
    start = np.ones(len(symbols), bool)
    start[1:] = symbols[1:] != symbols[:-1]
    start[first] = True
    if not start.all():
        at = np.flatnonzero(start)
        length = np.diff(np.append(at, len(symbols))).astype(np.uint64)
        symbols = symbols[at]
        runs = length > 1
        wide = symbols.astype(np.uint64)
        # Runs get 64-bit names; the bits above keep them apart from single symbols of the same text.
        wide[runs] = mixed(wide[runs] + length[runs] * np.uint64(0xC2B2AE3D27D4EB4F))
        symbols = wide
        first = np.searchsorted(at, first)
    label = _toss(symbols, first).astype(np.uint8)
    for _ in range(3):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = label[first] ^ 1
        label = _TABLE[label.astype(np.uint16) * np.uint16(128) + before]
    padded = np.concatenate([[0], label, [0]]).astype(np.int8)
    opening = np.zeros(len(label) + 1, bool)
    opening[first] = True
    closing = np.append(opening[1:-1], True)
    left, right = padded[:-2].copy(), padded[2:].copy()
    left[opening[:-1]] = -1
    right[closing] = -1
    head = (padded[1:-1] > left) & (padded[1:-1] >= right)
    head |= opening[:-1]
    at = np.flatnonzero(head)
    place = np.arange(len(symbols)) - np.repeat(at, np.diff(np.append(at, len(symbols))))
    named = mixed(symbols.astype(np.uint64) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return mixed(np.add.reduceat(named, at) + np.uint64(0x632BE59BD9B4E019)), np.searchsorted(at, first)


def sketches(texts: list[str], kept: int = KEPT, level: int = LEVEL) -> list[np.ndarray]:
    """Sorted 32-bit hashes of each text; none for an empty text."""
    out = [np.empty(0, np.uint32)] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    symbols = np.frombuffer("".join(texts[i] for i in full).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((len(texts[i]) for i in full), np.int64, len(full))
    first = np.cumsum(size) - size
    live = np.arange(len(full))
    names, owners, depth = [], [], 0
    while len(live):
        symbols, first = parse(symbols, first)
        depth += 1
        size = np.diff(np.append(first, len(symbols)))
        done = size == 1
        owner = np.repeat(live, size)
        # The name of a whole text always counts.
        counts = np.ones(len(symbols), bool) if depth >= level else np.repeat(done, size)
        names.append(mixed(symbols[counts] + np.uint64(depth)) >> np.uint64(32))
        owners.append(owner[counts])
        symbols = symbols[np.repeat(~done, size)]
        live, size = live[~done], size[~done]
        first = np.cumsum(size) - size
    code = np.unique((np.concatenate(owners).astype(np.uint64) << np.uint64(32)) | np.concatenate(names))
    owner, value = (code >> np.uint64(32)).astype(np.int64), code.astype(np.uint32)
    bounds = np.searchsorted(owner, np.arange(len(full) + 1))
    for k, i in enumerate(full):
        out[i] = value[bounds[k] : min(bounds[k + 1], bounds[k] + kept)]
    return out


def fingerprint(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Share of the least hashes of both that both hold: an estimate of the overlap of their names. Two empty texts: 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:kept]
    return float(np.isin(union, a).dot(np.isin(union, b).astype(int)) / len(union))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fingerprint)`` for each row: equal texts have equal fingerprints, null and empty texts the empty one.

    Repeated rows give repeated rows, null ids stay, other columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            made = [fingerprint(s) for s in sketches(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.string())], ["id", "fingerprint"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def _dealt(rows: DataFrame, ranges: int) -> DataFrame:
    """Rows with their range of ids, largest first, each range followed by a guest: the first row of the next range.

    Ids are longs; null ids count as the least. Only the bounds, one id per range, pass through the driver.
    """
    known = rows.select(F.coalesce("id", F.lit(-(2**63))).alias("id"))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = np.array(sorted({int(x) for x in known.approxQuantile("id", shares, 0.2 / ranges)}) if shares else [], np.int64)
    tops = _range_tops(known, bounds)
    sent = rows.sparkSession.sparkContext.broadcast((bounds, tops))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, tops = sent.value
        names = ["id", "text", "part", "guest"]
        for batch in batches:
            ids = batch.column("id").fill_null(-(2**63)).to_numpy()
            part = -np.searchsorted(bounds, ids, side="right")
            flags = np.zeros(len(ids), bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), pa.array(flags)], names)
            top = np.flatnonzero(np.isin(ids, tops))
            if len(top):
                # The range before in the order of falling ids; before the first comes the last.
                used = np.unique(-np.searchsorted(bounds, tops, side="right"))
                host = used[np.searchsorted(used, part[top]) - 1]
                taken = batch.take(pa.array(top))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(host), pa.array(np.ones(len(top), bool))], names)

    return rows.mapInArrow(run, "id long, text string, part long, guest boolean")


def _range_tops(known: DataFrame, bounds: np.ndarray) -> np.ndarray:
    """Largest id of each range that has rows; one row per task and range, then one per range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            ids = batch.column("id").to_numpy()
            part = np.searchsorted(bounds, ids, side="right")
            for p in np.unique(part).tolist():
                best[p] = max(best.get(p, -(2**63)), int(ids[part == p].max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())], ["part", "top"])

    tops = known.mapInArrow(run, "part long, top long").groupBy("part").agg(F.max("top").alias("top"))
    return np.sort(np.array([r["top"] for r in tops.collect()], np.int64))


EDITED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def edited_text(text: str, following: str) -> str:
    """The last half of the text replaced by as many first code points of the next one, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness; the next document by falling id gives the edit.

    The next of the least id is the largest id; rows of one id follow each other by the hash of their text. A single row is its
    own next. Ids are longs, a null id counts as the least and stays null; null text is empty; other columns are ignored; an empty
    table gives an empty result. Texts are dealt to ranges of ids once; a range keeps one row in memory at a time.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    ranges = max(1, min(RANGES, docs.count() // RANGE_ROWS))
    # A task for each range; a hash of the range would send several to one task and none to others.
    dealt = _dealt(rows, ranges).repartitionById(ranges, (-F.col("part")).cast("int"))
    order = [F.col("part"), F.col("guest"), F.col("id").desc_nulls_last(), F.xxhash64("text")]
    return dealt.sortWithinPartitions(*order).mapInArrow(_compare, EDITED).withColumnRenamed("id", id_col)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("id", "text", "part", "guest"))
        for row in zip(*columns):
            if held and held[-1][3] and row[3] and row[2] == held[-1][2]:
                continue  # of several guests the first is the next
            held.append(row)
            size += len(row[1])
            if size > 1_000_000 and len(held) > 1:
                yield _compared(held)
                held, size = held[-1:], len(row[1])
    if len(held) > 1:
        yield _compared(held)


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    """Rows that are followed by another of their range; the last one and guests only serve as next."""
    texts = [r[1] for r in rows]
    at = [i for i in range(len(rows) - 1) if not rows[i][3]]
    edited = [edited_text(texts[i], texts[i + 1]) for i in at]
    own, new = sketches(texts), sketches(edited)
    columns = [
        [rows[i][0] for i in at],
        [len(texts[i]) for i in at],
        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        [fingerprint(own[i]) for i in at],
        [fingerprint(s) for s in new],
        [likeness(own[i], s) for i, s in zip(at, new)],
        [likeness(own[i], own[i + 1]) for i in at],
    ]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], EDITED.names)

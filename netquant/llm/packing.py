"""Packing documents into windows by non-negative least squares over length combinations.

Pieces of up to one window are counted by length. Shallow combinations of length classes that fill a
window exactly are listed, the repeat count of each is solved against the histogram by non-negative least
squares (Lawson and Hanson) and rounded down. Planned sequences then get the exact lengths of their pieces; their real room, and new
sequences, are filled greedily with the pieces left, longest first, which may be cut to fill a sequence to its end. The plan is a table
whose size depends on the window only; documents meet it by their rank among pieces of their length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquant.lineage import cut as written
from netquant.llm.common import byte_batches, text_of
from netquant.llm.tokens import vocabulary

BATCH_BYTES = 8_000_000
#: Rows of one class that are ranked in one group.
RANKED = 20_000
#: Columns that place a part of a piece.
PLACE = ["sequence_id", "_slot", "_from", "_part"]


def pieces(
    docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, start, length, ids binary, doc_tokens)``: each document's ids and ``end_id``, cut at the window.

    ``ids`` are little-endian unsigned 32-bit integers. Null and empty texts hold ``end_id`` alone; repeated
    rows give repeated pieces, a null id stays null, other columns are ignored, an empty table gives no piece.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long"
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            at, start, length, cut, whole = [], [], [], [], []
            for row, coded in enumerate(vocab.encode(batch.column("text").to_pylist())):
                ids = np.concatenate([coded, end])
                for first in range(0, len(ids), window):
                    part = ids[first : first + window]
                    at.append(row)
                    start.append(first)
                    length.append(len(part))
                    cut.append(part.tobytes())
                    whole.append(len(ids))
            arrays = [batch.column("id").take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
            arrays += [pa.array(cut, pa.binary()), pa.array(whole, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "start", "length", "ids", "doc_tokens"])

    return rows.mapInArrow(run, schema)


def pack(cut: DataFrame, window: int = 4096, grain: int = 8, keys: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``window`` tokens, all kept whole; ``cut`` must be a written table.

    Each sequence holds pieces whose offsets follow each other without a gap and end at ``window`` at
    most. ``grain``: width of a length class in the least-squares problem, a divisor of the window; sequences are filled by exact lengths.
    ``keys`` order the pieces of a length; rows that
    are equal in them are interchangeable. An empty table gives an empty result; a length outside 1..window is an error.
    """
    placed = _assigned(cut, window, grain, keys, cutting=False)
    return _with_offset(placed, keys).drop("_slot", "_from", "_part")


def pack_full(cuts: DataFrame, window: int = 4096, grain: int = 8, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset)``: rows of :func:`pieces`, cut again so that sequences are full.

    All sequences but the last one end at ``window``. At most one piece is cut for each sequence. ``ids_crc32``: checksum of the
    piece's ids. Pieces are written once with their ids; only the cut ones meet their ids again.
    """
    named = cuts.withColumns({"ids_crc32": F.crc32("ids"), "_piece": F.monotonically_increasing_id()})
    stored = written(named, "pieces")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
    keys = (id_col, "start", "_piece")
    placed = written(_assigned(stored.select(*names, "_piece"), window, grain, keys, cutting=True), "placed")
    divided = F.col("_part") < F.col("length")
    inside = F.substring(F.col("ids"), (F.col("_from") * 4 + 1).cast("int"), (F.col("_part") * 4).cast("int"))
    parts = placed.filter(divided).join(stored.select("_piece", "ids"), "_piece").withColumn("ids_crc32", F.crc32(inside))
    both = placed.filter(~divided).unionByName(parts.select(*placed.columns))
    moved = both.withColumn("start", F.col("start") + F.col("_from")).withColumn("length", F.col("_part"))
    return _with_offset(moved, keys).select(*names, "sequence_id", "offset")


def _assigned(cut: DataFrame, window: int, grain: int, keys: tuple[str, ...], cutting: bool) -> DataFrame:
    """Pieces with ``sequence_id``, ``_slot``, ``_from`` and ``_part``: a row for each part, its first token and its length."""
    histogram = np.zeros(window + 1, np.int64)
    # At most as many rows as the window has tokens.
    for row in cut.groupBy(F.col("length").cast("long").alias("k")).agg(F.count("*").alias("n")).collect():
        if row["k"] is None or not 1 <= row["k"] <= window:
            raise ValueError(f"a piece has a length outside 1..{window}")
        histogram[row["k"]] = row["n"]
    # The plan's size depends on the window only.
    slots = cut.sparkSession.sparkContext.broadcast(slot_tables(plan(histogram, grain, cutting)))
    salts = max(1, -(-int(histogram.max()) // RANKED))
    ranked = _ranked(cut.withColumn("_class", F.col("length").cast("long")), keys, salts)
    names = [f for f in ranked.schema.fields if f.name not in ("_class", "_rank")]
    schema = T.StructType([*names, *(T.StructField(n, T.LongType()) for n in PLACE)])
    return ranked.mapInArrow(_place(slots, [f.name for f in names]), schema)


def _with_offset(placed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    order = Window.partitionBy("sequence_id").orderBy("_slot", *keys).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))


def _ranked(cut: DataFrame, keys: tuple[str, ...], salts: int) -> DataFrame:
    """Place of each piece in its class, from 0, without a class in one task: salted groups and their offsets."""
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    counts = salted.groupBy("_class", "_salt").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_class", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_class", "_salt").orderBy(*keys)
    ranked = salted.withColumn("_row", F.row_number().over(inside)).join(offsets, ["_class", "_salt"])
    return ranked.withColumn("_rank", F.col("_before") + F.col("_row") - 1).drop("_salt", "_row", "_before")


def _place(sent: Broadcast, names: list[str]):
    """Sequence, slot and extent of every part of a piece by its length and rank: a search in the plan's slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            klass, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_class", "_rank"))
            key, here, taken, made = (klass << 44) + rank, np.arange(batch.num_rows), [], []
            for table in sent.value:  # first parts, second parts, ...
                at = np.searchsorted(table["key"], key[here], side="right") - 1
                inside = key[here] - table["key"][at]
                found = (at >= 0) & (inside < table["count"][at])
                here, at, inside = here[found], at[found], inside[found]
                if not len(here):
                    break
                times = table["times"][at]
                taken.append(here)
                made.append([table["sequence"][at] + inside // times, table["slot"][at] + inside % times, table["from"][at], table["part"][at]])
            rows = batch.take(pa.array(np.concatenate(taken)))
            columns = [*(rows.column(n) for n in names), *(pa.array(np.concatenate(c)) for c in zip(*made))]
            yield pa.RecordBatch.from_arrays(columns, [*names, *PLACE])

    return run


def combinations(size: int, present: np.ndarray) -> list[tuple[tuple[int, int], ...]]:
    """Shallow combinations of the classes at hand that fill ``size`` exactly, as (class, times) pairs.

    Up to three pieces of any classes, and any number of pieces of one class with at most one of another.
    """
    here = np.zeros(size + 1, bool)
    here[1:] = present
    found: set[tuple[tuple[int, int], ...]] = set()
    for a in np.flatnonzero(here).tolist():
        for times in range(1, size // a + 1):
            rest = size - a * times
            if rest == 0:
                found.add(((a, times),))
            elif here[rest] and rest != a:
                found.add(tuple(sorted([(a, times), (rest, 1)])))
        for b in range(a + 1, (size - a) // 2 + 1):
            c = size - a - b
            if c > b and here[b] and here[c]:
                found.add(((a, 1), (b, 1), (c, 1)))
    return sorted(found)


def solve(combos: list[tuple[tuple[int, int], ...]], histogram: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|, by the active-set method."""
    size = len(histogram)
    width = max(len(c) for c in combos)
    rows, times = np.zeros((len(combos), width), np.int64), np.zeros((len(combos), width))
    for i, combo in enumerate(combos):
        for j, (klass, n) in enumerate(combo):
            rows[i, j], times[i, j] = klass - 1, n
    norm = np.sqrt((times**2).sum(1))
    scale = float(histogram.max())
    target = histogram / scale
    chosen: list[int] = []
    x = np.zeros(0)
    matrix = np.zeros((size, 0))
    residual = target.copy()
    for _ in range(3 * size):
        gain = (residual[rows] * times).sum(1) / norm
        gain[chosen] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-9:
            break
        column = np.zeros((size, 1))
        np.add.at(column[:, 0], rows[best], times[best])
        chosen.append(best)
        matrix, x = np.hstack([matrix, column]), np.append(x, 0.0)
        while True:
            z = np.linalg.solve(matrix.T @ matrix + 1e-12 * np.eye(len(x)), matrix.T @ target)
            if (z > 0).all():
                x = z
                break
            falling = z <= 0
            step = np.min(x[falling] / np.maximum(x[falling] - z[falling], 1e-300))
            x = x + step * (z - x)
            keep = x > 1e-12
            if keep.all():
                keep[np.flatnonzero(falling)[0]] = False
            chosen, x, matrix = [c for c, k in zip(chosen, keep) if k], x[keep], matrix[:, keep]
            if not len(x):
                break
        residual = target - matrix @ x
    out = np.zeros(len(combos))
    out[chosen] = x * scale
    return out


def planned(histogram: np.ndarray, size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Combinations of classes and how often each is used, no class more often than it is counted."""
    left = np.concatenate([[0], histogram]).astype(np.int64)
    used: list[tuple[tuple[tuple[int, int], ...], int]] = []
    combos = combinations(size, histogram > 0)
    if combos:
        counts = solve(combos, histogram)
        for i in np.argsort(-counts, kind="stable"):
            n = int(counts[i] + 1e-6)
            if n <= 0:
                break
            n = min(n, *(int(left[k]) // times for k, times in combos[i]))
            if n > 0:
                used.append((combos[i], n))
                for k, times in combos[i]:
                    left[k] -= n * times
    return used


def exact(used: list[tuple[tuple[tuple[int, int], ...], int]], left: np.ndarray, grain: int):
    """The combinations with lengths for classes, longest pieces of a class first, as (room, (length, times) pairs, count); lowers ``left``."""
    window, out = len(left) - 1, []
    for combo, n in used:
        while n:
            recipe: list[tuple[int, int]] = []
            for k, need in combo:
                for length in range(k * grain, (k - 1) * grain, -1):
                    times = min(int(left[length]), need)
                    if times:
                        recipe.append((length, times))
                        need -= times
            m = min(n, *(int(left[length]) // times for length, times in recipe))
            for length, times in recipe:
                left[length] -= m * times
            out.append((window - sum(length * times for length, times in recipe), recipe, m))
            n -= m
    return out


def dissolve(groups: list, left: np.ndarray) -> list:
    """Groups without the roomiest sequences, whose pieces go back to ``left`` until it holds enough tokens to fill all other rooms."""
    window = len(left) - 1
    lack = sum(room * n for room, _, n in groups) - int(left @ np.arange(window + 1))
    away, out = max(0, -(-lack // window)), []
    for room, recipe, n in sorted(groups, key=lambda g: -g[0]):
        gone = min(away, n)
        away -= gone
        for length, times in recipe:
            left[length] += gone * times
        if n > gone:
            out.append((room, recipe, n - gone))
    return out


class Lot(NamedTuple):
    """Pieces of one length with consecutive ranks, of which the first ``start`` tokens are placed in ``depth`` parts."""

    whole: int
    low: int
    count: int
    start: int
    depth: int


class Stock:
    """Pieces not yet placed, by the length of what is left of them; ``rows`` tells where the others are."""

    def __init__(self, histogram: np.ndarray):
        self.left = histogram.astype(np.int64)
        self.lots = [deque([Lot(k, 0, int(n), 0, 0)] if n else []) for k, n in enumerate(histogram)]
        self.rows: list[tuple[int, ...]] = []

    def draw(self, length: int, times: int, sequence: int, n: int, slot: int, part: int | None = None) -> None:
        """Put ``times`` pieces into each of ``n`` sequences; with ``part`` only so many of their tokens, the rest goes back."""
        part = part or length
        lots, at, total = self.lots[length], 0, times * n
        self.left[length] -= total
        while at < total:
            lot = lots.popleft()
            begun = at % times
            if begun or lot.count < times:  # sequences that pieces of several lots share
                m = each = min(lot.count, times - begun)
            else:
                m, each = min(lot.count, total - at) // times * times, times
            self.rows.append((lot.depth, lot.whole, lot.low, m, lot.start, part, sequence + at // times, slot + begun, each))
            if lot.count > m:
                lots.appendleft(lot._replace(low=lot.low + m, count=lot.count - m))
            if part < length:
                self.lots[length - part].append(lot._replace(count=m, start=lot.start + part, depth=lot.depth + 1))
                self.left[length - part] += m
            at += m

    def fill(self, room: int, sequence: int, n: int, slot: int, cutting: bool) -> int:
        """Fill up to ``n`` sequences of equal room: always the longest piece that fits, at last a cut one. Returns how many got the same."""
        recipe: list[tuple[int, int]] = []
        fits = np.flatnonzero(self.left[: room + 1])
        while len(fits):
            k = int(fits[-1])
            recipe.append((k, min(int(self.left[k]), room // k)))
            room -= k * recipe[-1][1]
            fits = fits[: np.searchsorted(fits, min(room, k - 1), side="right")]
        need, divided = dict(recipe), 0
        if cutting and room:
            # Pieces that fit are all taken, so those left are longer than the room.
            for k in np.flatnonzero(self.left)[::-1].tolist():
                if self.left[k] > need.get(k, 0):
                    divided, need[k] = k, need.get(k, 0) + 1
                    break
        n = min([n, *(int(self.left[k]) // times for k, times in need.items())])
        for k, times in recipe:
            self.draw(k, times, sequence, n, slot)
            slot += times
        if divided:
            self.draw(divided, 1, sequence, n, slot, room)
        return n


def plan(histogram: np.ndarray, grain: int, cutting: bool) -> list[tuple[int, ...]]:
    """Rows (part number, length, first rank, count, first token, tokens, sequence, slot, pieces a sequence) that place every counted piece.

    ``histogram``: pieces of each length from 0 to the window.
    """
    window = len(histogram) - 1
    size = window // grain
    classes = np.zeros(size + 1, np.int64)
    np.add.at(classes, -(-np.arange(window + 1) // grain), histogram)
    stock, left = Stock(histogram), histogram.astype(np.int64)
    groups, sequence = dissolve(exact(planned(classes[1:], size), left, grain), left), 0
    rooms = []
    for room, recipe, n in groups:
        slot = 0
        for length, times in recipe:
            stock.draw(length, times, sequence, n, slot)
            slot += times
        rooms.append((room, sequence, n, slot))
        sequence += n
    for room, first, n, slot in rooms:
        while room and n and stock.left.any():
            m = stock.fill(room, first, n, slot, cutting)
            first, n = first + m, n - m
    while stock.left.any():
        sequence += stock.fill(window, sequence, int(stock.left.sum()), 0, cutting)
    return stock.rows


def slot_tables(rows: list[tuple[int, ...]]) -> list[dict[str, np.ndarray]]:
    """For the first, second, ... parts of pieces: rank ranges of each length with the sequences and slots they go to, sorted."""
    out, table = [], np.array(rows, np.int64).reshape(-1, 9)
    for depth in range(int(table[:, 0].max(initial=-1)) + 1):
        here = table[table[:, 0] == depth]
        key = (here[:, 1] << 44) + here[:, 2]
        order = np.argsort(key, kind="stable")
        names = ["count", "from", "part", "sequence", "slot", "times"]
        out.append({"key": key[order]} | {name: here[order, i] for i, name in enumerate(names, 3)})
    return out

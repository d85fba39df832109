"""Hard negatives by an R-tree packed with sort-tile-recursive.

Vectors of whole numbers are sorted into slices of their leading coordinates and packed, in that order, into tiles; a tile packs its rows into leaves the same
way. Leaves carry minimum bounding boxes, the tile their hull; the label is one more coordinate of a box. For a query vector a box gives an interval per coordinate and, summed, an interval of inner
products. A query takes boxes best first from its queue, leaves out those whose interval lies outside its score window, and stops at the first whose upper
end is strictly below its kth score so far. Blocks of queries meet tiles in Spark; each pair sends at most k rows per query, which windows merge.

The bound of a box is loose in many dimensions: on vectors without structure hardly any box is left out, and the work is queries times rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netquant.lineage import cut

#: Rows of a tile, of a leaf, and queries of a block; leaves that a query takes from its queue at once.
TILE, LEAF, BLOCK, TAKEN = 32_768, 128, 1_024, 8
#: Tiles that share a copy of the query blocks.
TILES_PER_SLOT = 4
#: Coordinates that cut the slices, vectors that choose them, most slices of a coordinate. They shape the tiles and change no result.
LEADING, SAMPLE, MOST_SLICES = 3, 10_000, 32
#: Components that a tile, and a block, hold at most: longer vectors make smaller ones.
TILE_CELLS, BLOCK_CELLS = 2_500_000, 1_000_000
#: A window without a lower or upper end.
NO_LOW, NO_HIGH = -(1 << 63), (1 << 63) - 1
BLOCKED = ["q_row", "q_id", "q_label", "q_vector", "owner", "low", "high", "key"]


def whole_numbers(vector: str, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as a double; null where a component is null or not finite, also after scaling."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") * F.lit(scale))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Floors of large doubles are themselves; FLOOR would turn them into longs.
    floor = lambda x: F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x)
    return F.when(finite, F.transform(v, floor))


def tile_rows(size: int) -> int:
    return max(1, min(TILE, TILE_CELLS // size))


def slots_of(size: int, total: int) -> int:
    return max(1, -(-total // (tile_rows(size) * TILES_PER_SLOT)))


def _slices(rows: DataFrame, size: int, total: int) -> list[tuple[int, np.ndarray]]:
    """Leading coordinates of vectors of one length, and the bounds of their slices, from a bounded sample."""
    sample = rows.filter(F.size("q") == size).orderBy(F.xxhash64("q")).limit(SAMPLE).select("q").collect()
    q = np.array([r["q"] for r in sample], float).reshape(len(sample), size)
    axes = np.argsort(-np.ptp(q, axis=0), kind="stable")[:LEADING] if len(q) else []
    n = int(min(MOST_SLICES, np.ceil((total / tile_rows(size)) ** (1 / LEADING))))
    return [(int(c), np.unique(np.quantile(q[:, c], np.arange(1, n) / n))) for c in axes]


def _packed_order(label: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Leaf order of a tile: by label, within it by sort-tile-recursive over the widest coordinates."""
    order = np.lexsort((label,))
    bounds = np.flatnonzero(np.diff(label[order])) + 1
    parts = []
    for group in np.split(order, bounds):
        leaves = -(-len(group) // LEAF)
        axes = np.argsort(-np.ptp(q[group], axis=0), kind="stable")[:LEADING] if leaves > 1 else []
        parts.append(_tiled(group, q, list(axes), leaves))
    return np.concatenate(parts)


def _tiled(group: np.ndarray, q: np.ndarray, axes: list[int], leaves: int) -> np.ndarray:
    """Sort by the first axis, cut into slices of whole leaves, and go on with the next axis in each."""
    if not axes or leaves < 2:
        return group
    group = group[np.argsort(q[group, axes[0]], kind="stable")]
    slices = int(np.ceil(leaves ** (1 / len(axes))))
    each = -(-leaves // slices)
    cuts = [group[i : i + each * LEAF] for i in range(0, len(group), each * LEAF)]
    return np.concatenate([_tiled(c, q, axes[1:], -(-len(c) // LEAF)) for c in cuts])


TREE = "tile string, slot int, size int, ids binary, labels binary, wide boolean, q binary"


def _matrix(data: bytes, wide: bool, size: int) -> np.ndarray:
    return np.frombuffer(data, np.float64 if wide else np.int16).reshape(-1, size)


def _is_wide(q: np.ndarray) -> bool:
    return bool(len(q)) and float(np.abs(q).max()) > 32_767


def packed_tiles(rows: DataFrame, size: int, total: int) -> DataFrame:
    """Tiles of the vectors of one length: rows in leaf order, at most ``tile_rows`` each."""
    leading = _slices(rows, size, total)
    keys = []
    for i, (axis, bounds) in enumerate(leading[:-1]):
        level = F.lit(0)
        for b in bounds.tolist():
            level = level + F.when(F.get("q", F.lit(axis)) > F.lit(b), 1).otherwise(0)
        keys.append(level.alias(f"s{i}"))
    last = F.get("q", F.lit(leading[-1][0])) if leading else F.lit(0.0)
    sliced = rows.filter(F.size("q") == size).select("id", "label", "q", *keys, last.alias("last"))
    order = [*(f"s{i}" for i in range(len(keys))), "last", "id", "label"]
    # The id ends the order, so that equal vectors spread over ranges as well.
    dealt = sliced.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "label", "q")
    slots, most = slots_of(size, total), tile_rows(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, at = [], 0, 0
        task = TaskContext.get().partitionId()

        def packed(table: pa.Table) -> pa.RecordBatch:
            ids, label = table.column("id").to_numpy(), table.column("label").to_numpy()
            q = table.column("q").combine_chunks()
            q = np.asarray(q.flatten(), np.float64).reshape(len(ids), size)
            order = _packed_order(label, q)
            wide = _is_wide(q)
            blob = q[order].astype(np.float64 if wide else np.int16).tobytes()
            name = f"{task}-{at}"
            slot = int(np.uint64(hash((task, at)) & 0x7FFFFFFF)) % slots
            row = [[name], [slot], [size], [ids[order].tobytes()], [label[order].tobytes()], [wide], [blob]]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], ["tile", "slot", "size", "ids", "labels", "wide", "q"])

        for batch in batches:
            first = 0
            while first < batch.num_rows:
                take = min(most - n, batch.num_rows - first)
                held.append(batch.slice(first, take))
                n, first = n + take, first + take
                if n == most:
                    yield packed(pa.Table.from_batches(held))
                    held, n, at = [], 0, at + 1
        if n:
            yield packed(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, TREE)


class Tile:
    """Leaves of a tile with their boxes."""

    def __init__(self, ids: bytes, labels: bytes, wide: bool, q: bytes, size: int) -> None:
        self.id, self.label = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.q = _matrix(q, wide, size).astype(np.float64)
        n = len(self.id)
        # A leaf never holds rows of two labels unless its label has few rows: leaves begin at multiples of LEAF within the tile.
        self.first = np.arange(0, n, LEAF)
        self.last = np.minimum(self.first + LEAF, n)
        self.low, self.high = np.minimum.reduceat(self.q, self.first), np.maximum.reduceat(self.q, self.first)
        self.label_low, self.label_high = np.minimum.reduceat(self.label, self.first), np.maximum.reduceat(self.label, self.first)
        self.reach = float(np.abs(self.q).max())


def intervals(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with any point of each box."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def search(tile: Tile, queries: np.ndarray, owner: np.ndarray, own_id: np.ndarray, own_label: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
    """The k best rows of a tile for each request, as (request, score, id): highest score first, ties by smaller id.

    Request r asks for rows whose inner product with ``queries[owner[r]]`` lies in [low, high], of the same label as the query or of another one, other than the query itself.
    """
    n = len(owner)
    exact = float(np.abs(queries).max(initial=0)) * tile.reach * queries.shape[1] < 2**52
    low, high = (np.where(x == none, np.sign(none) * np.inf, x.astype(float if exact else object)) for x, none in ((low, NO_LOW), (high, NO_HIGH)))
    best = np.full((n, k), -np.inf) if exact else np.full((n, k), -np.inf, object)
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    least, most = intervals(tile.low, tile.high, queries)
    # Bounds of numbers that doubles don't hold exactly are widened.
    slack = 0.0 if exact else float(np.abs(queries).max() * tile.reach * queries.shape[1] * 1e-12)
    queue = np.argsort(-most, axis=1, kind="stable")
    pure = tile.label_low == tile.label_high
    open_ = np.arange(n)
    for step in range(0, len(tile.first), TAKEN):
        wanted = queue[owner[open_], step : step + TAKEN]
        bar = np.maximum(best[open_, k - 1], low[open_]).astype(float)
        top = np.take_along_axis(most[owner[open_]], wanted, 1)
        # The queue is ordered: once its best box lies strictly below the bar, so does the rest.
        going = top[:, 0] + slack >= bar
        open_, wanted, top, bar = open_[going], wanted[going], top[going], bar[going]
        if not len(open_):
            break
        fits = (top + slack >= bar[:, None]) & (np.take_along_axis(least[owner[open_]], wanted, 1) - slack <= high[open_, None].astype(float))
        label = own_label[owner[open_], None]
        if same:
            fits &= (tile.label_low[wanted] <= label) & (label <= tile.label_high[wanted])
        else:
            fits &= ~(pure[wanted] & (tile.label_low[wanted] == label))
        request, column = np.nonzero(fits)
        leaf = wanted[request, column]
        order = np.argsort(leaf, kind="stable")
        leaf, request = leaf[order], open_[request[order]]
        bounds = np.flatnonzero(np.diff(leaf)) + 1
        for part, box in zip(np.split(request, bounds), leaf[np.concatenate([[0], bounds])] if len(leaf) else ()):
            _leaf(tile, slice(tile.first[box], tile.last[box]), part, queries, owner, own_id, own_label, low, high, same, best, best_id, exact)
    request, place = np.nonzero(best != -np.inf)
    return request, best[request, place], best_id[request, place]


def _leaf(tile, rows, part, queries, owner, own_id, own_label, low, high, same, best, best_id, exact) -> None:
    """Merge a leaf's rows into the best of the requests ``part``."""
    k = best.shape[1]
    asked, back = np.unique(owner[part], return_inverse=True)
    if exact:
        score = (queries[asked] @ tile.q[rows].T)[back]
    else:
        whole = np.frompyfunc(int, 1, 1)
        score = (whole(queries[asked]) @ whole(tile.q[rows]).T)[back]
    alike = own_label[owner[part], None] == tile.label[None, rows]
    fits = (alike if same else ~alike) & (own_id[owner[part], None] != tile.id[None, rows])
    fits &= (score >= np.maximum(low[part], best[part, k - 1])[:, None]) & (score <= high[part, None])
    hit = np.flatnonzero(fits.any(1))
    if not len(hit):
        return
    part = part[hit]
    scores = np.concatenate([best[part], np.where(fits[hit], score[hit], -np.inf)], axis=1)
    ids = np.concatenate([best_id[part], np.broadcast_to(tile.id[rows], (len(hit), rows.stop - rows.start))], axis=1)
    if exact:
        order = np.lexsort((ids, -scores))[:, :k]
    else:
        order = np.array([sorted(range(scores.shape[1]), key=lambda j: (-scores[r, j], ids[r, j]))[:k] for r in range(len(hit))])
    best[part], best_id[part] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _blocks(queries: DataFrame, size: int, slots: int) -> DataFrame:
    """Queries of one length in blocks, each sent to every slot of tiles. ``queries``: ``(row, id, label, q, windows array<struct<low, high, key>>)``."""
    step = max(1, min(BLOCK, BLOCK_CELLS // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                ids, label = part.column("id").to_numpy(), part.column("label").to_numpy()
                q = np.asarray(part.column("q").flatten(), np.float64).reshape(len(ids), size)
                windows = part.column("windows")
                counts = np.asarray(pc.list_value_length(windows), np.int64)
                flat = windows.flatten()
                owner = np.repeat(np.arange(len(ids)), counts)
                cells = [owner, *(np.asarray(flat.field(c), np.int64) for c in ("low", "high", "key"))]
                row = [part.column("row").to_numpy().tobytes(), ids.tobytes(), label.tobytes(), q.tobytes(), *(c.tobytes() for c in cells)]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in row], BLOCKED)

    blocks = queries.filter(F.size("q") == size).select("row", "id", "label", "q", "windows").mapInArrow(run, ", ".join(f"{c} binary" for c in BLOCKED))
    return blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))


def _found(tiles: DataFrame, blocks: DataFrame, size: int, k: int, same: bool) -> DataFrame:
    """``(query, key, score, id)``: at most k rows of each tile for each window of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str, Tile] | None = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                if known is None or known[0] != row["tile"]:
                    known = (row["tile"], Tile(row["ids"], row["labels"], row["wide"], row["q"], size))
                own_row, own_id, own_label = (np.frombuffer(row[c], np.int64) for c in ("q_row", "q_id", "q_label"))
                queries = np.frombuffer(row["q_vector"], np.float64).reshape(-1, size)
                owner, low, high, key = (np.frombuffer(row[c], np.int64) for c in ("owner", "low", "high", "key"))
                request, score, found = search(known[1], queries, owner, own_id, own_label, low, high, k, same)
                # A long is the widest number that Spark counts with; scores beyond it become the nearest one.
                score = score.astype(np.int64) if score.dtype != object else np.array([min(max(int(s), NO_LOW), NO_HIGH) for s in score], np.int64)
                columns = [own_row[owner[request]], key[request], score, found]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["query", "key", "score", "id"])

    joined = blocks.join(tiles, "slot").select("tile", "ids", "labels", "wide", "q", *BLOCKED)
    return joined.mapInArrow(run, "query long, key long, score long, id long")


def _best(found: DataFrame, keys: list[str], k: int, out: str) -> DataFrame:
    """The k best of each key; tasks drop the others before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= k)


def mine(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 3,
    floor: int = 50, ceiling: int = 95, scale: float = 256.0,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows that ``anchor`` holds for.

    Components become floor(``scale`` * x); a score is the inner product of two rows. An anchor's positives are its first ``positives`` other rows of the same label, a
    positive's negatives the first ``negatives`` rows of other labels with ``floor`` * positive_score <= 100 * negative_score <= ``ceiling`` * positive_score; higher scores come first, ties by smaller id.
    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Vectors of different length have no score. Repeated rows count once;
    rows of the anchor's own id are never its partners. Other columns are ignored; an empty table gives an empty result.

    Of equal vectors of one label only those of the smallest ids can be among the first, so no more are searched; all of them are anchors.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole_numbers(vector_col, scale).alias("q"), F.coalesce(anchor, F.lit(False)).alias("anchor")
    )
    rows = rows.filter("id is not null and label is not null and q is not null and size(q) > 0")
    # Numbered and written: rows of one id may differ.
    rows = cut(rows.groupBy("id", "label", "q").agg(F.max("anchor").alias("anchor")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    keep = max(positives + 1, negatives + 1)
    alike = Window.partitionBy("q", "label").orderBy("id")
    searched = cut(rows.withColumn("place", F.row_number().over(alike)).filter(F.col("place") <= keep).drop("place"), "searched")
    anchors = rows.filter("anchor")
    spark = vectors.sparkSession
    result = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # One row per length of vectors among the anchors.
    lengths = anchors.select(F.size("q").alias("size")).distinct()
    for size, total in searched.groupBy(F.size("q").alias("size")).count().join(lengths, "size").orderBy("size").collect():
        tiles = cut(packed_tiles(searched, size, total), "tiles")
        slots = slots_of(size, total)
        free = F.array(F.struct(F.lit(NO_LOW).alias("low"), F.lit(NO_HIGH).alias("high"), F.lit(0).cast("long").alias("key")))
        first = _found(tiles, _blocks(anchors.withColumn("windows", free), size, slots), size, positives, True)
        chosen = _best(first, ["query"], positives, "place")
        chosen = cut(chosen.select(F.col("query").alias("row"), F.col("place").cast("long").alias("key"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        # 100 n >= floor p and 100 n <= ceiling p in whole numbers.
        down, up = (f"cast(positive_score as decimal(20,0)) * {f}" for f in (floor, ceiling))
        low, high = F.expr(f"({down} + pmod(-({down}), 100)) div 100"), F.expr(f"({up} - pmod({up}, 100)) div 100")
        windows = chosen.withColumns({"low": low, "high": high}).filter("low <= high")
        asked = windows.groupBy("row").agg(F.collect_list(F.struct("low", "high", "key")).alias("windows"))
        second = _found(tiles, _blocks(anchors.join(asked, "row"), size, slots), size, negatives, False)
        best = _best(second, ["query", "key"], negatives, "rank")
        named = best.select(F.col("query").alias("row"), "key", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        whole = named.join(chosen, ["row", "key"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
        result = result.union(whole.select(*result.columns))
    return result

"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

A document is a weighted set of five-word shingles. Improved consistent weighted sampling draws, for each of K hashes, one
shingle and weight level with the probability that two documents share them equal to their weighted Jaccard similarity. Draws are cut into
bands; documents that share a band are verified by their exact weighted Jaccard. In each bucket members meet its leader first; only members
that fail and still lie in another component meet the others, so a large group of copies costs a pair per member and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquant.lineage import cut
from netquant.llm.common import byte_batches, hook
from netquant.llm.features import chunks, mixed, plain_word_hashes
from netquant.operators.components import connected_components

BATCH_BYTES = 8_000_000
WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 14, 3
DRAWS = BANDS * ROWS
#: Equal draws from which a pair is verified: at similarity 0.8 one pair in about ten thousand has fewer.
AGREE = 24
#: Buckets of the document-frequency sketch, and how much a rare shingle outweighs one that every document has.
SKETCH, RARE = 1 << 18, 0.25
#: Bits that a shingle's hash leaves to the number of its text, so that both sort as one number.
OWNER_BITS = 14
#: Features of a tile that are multiplied at once.
STEP = 2_048
#: Shingles that are drawn from at once.
LOCAL = 32_768
#: Members of one side of a bucket that meet in one group.
TILE = 1_500


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle, its count and text number, sorted by text; and the number of words of each text.

    Words are lower-case runs of letters and digits. A text of fewer than five words is one shingle, one without words has none.
    """
    word, doc = plain_word_hashes([t.lower() for t in texts])
    words = np.bincount(doc, minlength=len(texts))
    if not len(word):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), words
    padded = np.concatenate([word, np.zeros(WORDS, np.uint64)])
    code, inside = np.zeros(len(word), np.uint64), np.append(doc, np.full(WORDS, -1))
    for k in range(WORDS):
        # Words beyond the text's end count as none, so a short text is one shingle.
        part = padded[k : k + len(word)]
        code = code * np.uint64(0x9E3779B97F4A7C15) + (part if k == 0 else np.where(inside[k : k + len(word)] == doc, part, np.uint64(0)))
    first = np.cumsum(words) - words
    place = np.arange(len(word)) - first[doc]
    begins = place <= np.maximum(words - WORDS, 0)[doc]
    code, owner = mixed(code[begins]) >> np.uint64(OWNER_BITS), doc[begins]
    if len(texts) < 1 << OWNER_BITS:
        packed = np.sort((owner.astype(np.uint64) << np.uint64(64 - OWNER_BITS)) | code)
        owner, code = (packed >> np.uint64(64 - OWNER_BITS)).astype(np.int64), packed & np.uint64((1 << (64 - OWNER_BITS)) - 1)
    else:
        order = np.lexsort((code, owner))
        code, owner = code[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])]))
    return code[head], np.diff(np.append(head, len(code))), owner[head], words


def rarity(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """IDF factor of every sketch bucket, from 1 to 1 + ``RARE``.

    Document frequencies over all documents are counted in ``SKETCH`` buckets and less the mean of a bucket, which is what rare shingles
    alone put there; a task sends at most one row per bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(SKETCH, np.int64), 0
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            n += batch.num_rows
            for _, part in chunks(batch.column("text").to_pylist()):
                count += np.bincount((shingles(part)[0] % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(count[at], n))], ["bucket", "n"]
        )

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket int, n long")
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # one row per bucket
    total = int(found.loc[found["bucket"] == -1, "n"].sum())
    found = found[found["bucket"] >= 0]
    count = np.zeros(SKETCH)
    count[found["bucket"]] = found["n"]
    frequency = np.maximum(count - count.mean(), 1.0)
    return 1 + RARE * np.clip(1 - np.log(frequency) / np.log(max(total, 2)), 0, 1)


def weights(code: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return count * idf[(code % np.uint64(SKETCH)).astype(np.int64)]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 16 random bits: a Gamma(2, 1) quantile, its logarithm, its reciprocal."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.full(len(u), 1.7)
    for _ in range(60):  # Newton on 1 - (1 + x) exp(-x) = u, kept positive
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), x / 4)
    return x.astype(np.float32), np.log(x).astype(np.float32), (1 / x).astype(np.float32)


def draws(code: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text (``first``: where its shingles begin) and hash the drawn (shingle, level), as 32-bit numbers."""
    gamma, log_gamma, inverse = _tables()
    log_weight = np.log(weight).astype(np.float32)
    best = np.full((DRAWS, len(first)), np.iinfo(np.uint64).max, np.uint64)
    half = np.uint64(32)
    for begin in range(0, len(code), LOCAL):  # a run that stays in the processor's cache
        end = min(begin + LOCAL, len(code))
        one, two = int(np.searchsorted(first, begin, side="right")) - 1, int(np.searchsorted(first, end))
        heads = np.maximum(first[one:two] - begin, 0)
        for k in range(DRAWS):
            bits = mixed(code[begin:end] + np.uint64((k + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
            a, b, c = (bits.view(np.uint16).reshape(-1, 4)[:, i] for i in range(3))
            shift = c.astype(np.float32) * np.float32(2**-16)
            level = np.floor(log_weight[begin:end] * inverse[a] + shift)
            rank = log_gamma[b] - gamma[a] * (level - shift + np.float32(1))
            # The bits of a float in an order that integers keep.
            order = rank.view(np.uint32)
            order = order ^ ((rank.view(np.int32) >> np.int32(31)).view(np.uint32) | np.uint32(1 << 31))
            name = (bits >> np.uint64(20)).astype(np.uint32) + level.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
            least = np.minimum.reduceat((order.astype(np.uint64) << half) | name, heads)
            np.minimum(best[k, one:two], least, out=best[k, one:two])
    return np.ascontiguousarray(best.T.astype(np.uint32))


def signatures(docs: DataFrame, idf: Broadcast, id_col: str, text_col: str) -> DataFrame:
    """``(id, text_hash, word_key, draws)``: texts of the same words share ``word_key``, without words equal texts do; null and empty texts have none, texts without words no draws."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = idf.value
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            keys, sigs = [], []
            for _, part in chunks(batch.column("text").to_pylist()):
                code, count, owner, words = shingles(part)
                full = np.flatnonzero(words)
                first = np.searchsorted(owner, full)
                drawn = dict(zip(full.tolist(), draws(code, weights(code, count, factor), first))) if len(full) else {}
                bounds = np.append(first, len(code))
                for k, at in enumerate(full.tolist()):
                    lo, hi = bounds[k], bounds[k + 1]
                    drawn[at] = (xxhash.xxh3_128_hexdigest(code[lo:hi].tobytes() + count[lo:hi].tobytes()), drawn[at].tobytes())
                for at in range(len(part)):
                    key, sig = drawn.get(at, (None, None))
                    if key is None and part[at]:
                        key = "signs-" + xxhash.xxh3_128_hexdigest(part[at].encode("utf-8", "surrogatepass"))
                    keys.append(key)
                    sigs.append(sig)
            arrays = [batch.column("id"), batch.column("text_hash"), pa.array(keys, pa.string()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "text_hash", "word_key", "draws"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text_hash long, word_key string, draws binary")


def bands(nodes: DataFrame) -> DataFrame:
    """``(node, band, key)``: one row per node and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            drawn = np.frombuffer(b"".join(batch.column("draws").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), drawn.shape[:2]).copy()
            for r in range(ROWS):
                key = mixed(key * np.uint64(0x100000001B3) + drawn[:, :, r] + np.uint64(1))
            node = np.repeat(batch.column("node").to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(band), pa.array(key.ravel().view(np.int64))], ["node", "band", "key"])

    return nodes.select("node", "draws").mapInArrow(run, "node long, band int, key long")


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose signatures agree often enough to be verified."""
    sides = [nodes.select(F.col("node").alias(s), F.col("draws").alias(f"draws_{s}")) for s in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(f"draws_{s}").to_pylist()), np.uint32).reshape(-1, DRAWS) for s in "ab")
                keep = pa.array((one == two).sum(1) >= AGREE)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(run, "a long, b long")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted (shingle, weight) sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / (a[1].sum() + b[1].sum() - low))


def verified(pairs: DataFrame, texts: DataFrame, idf: Broadcast, similar: float = SIMILAR) -> DataFrame:
    """The pairs ``(a, b)`` whose weighted Jaccard similarity is at least ``similar``. ``texts``: ``(node, text)``."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def weighed(text: str, factor: np.ndarray):
        code, count, _, _ = shingles([text])
        return code, weights(code, count, factor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, last = idf.value, (None, None)
        for batch in batches:
            a, b, keep = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            texts_a, texts_b = batch.column("text_a"), batch.column("text_b")
            for at in range(batch.num_rows):
                if b[at] != last[0]:  # rows of one leader follow each other
                    last = (b[at], weighed(texts_b[at].as_py(), factor))
                keep.append(similarity(weighed(texts_a[at].as_py(), factor), last[1]) >= similar)
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def _leaders(banded: DataFrame) -> DataFrame:
    """``(node, band, key, leader)`` for members of buckets of two or more; three orders of nodes choose leaders."""
    order = F.struct(F.xxhash64(F.col("band") % 3, "node").alias("h"), F.col("node").alias("node"))
    led = banded.groupBy("band", "key").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return banded.join(led.select("band", "key", F.col("first.node").alias("leader")), ["band", "key"])


def _remaining(
    members: DataFrame, links: DataFrame, component: DataFrame, nodes: DataFrame, texts: DataFrame, idf: Broadcast, similar: float = SIMILAR
) -> DataFrame:
    """Further links: in each bucket, members that failed with the leader meet the members of other components.

    Both sides of a bucket are dealt to tiles of bounded size. A tile first compares draws alone and keeps the rows that have a partner
    (``_partnered``); only these fetch their texts. It then sends a spanning forest of its links, never its pairs.
    """
    joined = links.select(F.col("a").alias("node"), F.col("b").alias("leader"), F.lit(True).alias("linked")).distinct()
    held = members.join(joined, ["node", "leader"], "left").join(component, "node", "left")
    held = held.select(
        "band", "key", "node", F.coalesce("component", "node").alias("component"),
        (F.col("linked").isNull() & (F.col("node") != F.col("leader"))).cast("int").alias("failed"),
    )
    sizes = held.groupBy("band", "key").agg(
        F.sum("failed").alias("nu"), F.count("*").alias("nm"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    mixed_buckets = sizes.filter("nu > 0 and lo < hi").select(
        "band", "key", F.ceil(F.col("nu") / TILE).cast("int").alias("pu"), F.ceil(F.col("nm") / TILE).cast("int").alias("pm")
    )
    rows = cut(held.join(mixed_buckets, ["band", "key"]), "mixed-buckets")
    spot = lambda parts: F.pmod(F.xxhash64(F.lit(5), "node"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    fields = ["band", "key", "node", "component"]
    failed = rows.filter("failed = 1").select(*fields, F.lit(0).alias("side"), spot("pu").alias("u"), every("pm").alias("m"))
    others = rows.select(*fields, F.lit(1).alias("side"), every("pu").alias("u"), spot("pm").alias("m"))
    tile = ["band", "key", "u", "m"]
    dealt = failed.union(others).join(nodes.select("node", "draws"), "node").select(*TILED, "draws")
    met = dealt.groupBy(*tile).applyInArrow(_partnered, dealt.drop("draws").schema)

    def run(group: pa.Table) -> pa.Table:
        return _across(group, idf.value, similar)

    return cut(met, "partnered").join(texts, "node").groupBy(*tile).applyInArrow(run, "a long, b long")


TILED = ["band", "key", "u", "m", "side", "node", "component"]


def _partnered(group: pa.Table) -> pa.Table:
    """Rows of a tile with a partner on its other side: of another component, with ``AGREE`` equal draws, and no earlier band in common.

    Two members of different components that share an earlier band also meet there: at least one of them failed with that bucket's leader.
    """
    side, component, band = group.column("side").to_numpy(), group.column("component").to_numpy(), group.column("band")[0].as_py()
    drawn = np.frombuffer(b"".join(group.column("draws").to_pylist()), np.uint32).reshape(-1, DRAWS)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    open_ = component[left][:, None] != component[right][None, :]
    agree = np.zeros(open_.shape, np.uint8)
    for k in range(0, DRAWS, ROWS):
        equal = [drawn[left, k + r][:, None] == drawn[right, k + r][None, :] for r in range(ROWS)]
        for e in equal:
            agree += e
        if k // ROWS < band:
            open_ &= ~np.logical_and.reduce(equal)
    open_ &= agree >= AGREE
    keep = np.zeros(len(side), bool)
    keep[left], keep[right] = open_.any(1), open_.any(0)
    return group.select(TILED).filter(pa.array(keep))


def _across(group: pa.Table, factor: np.ndarray, similar: float) -> pa.Table:
    side, node, component = (group.column(c).to_numpy() for c in ("side", "node", "component"))
    code, count, owner, _ = shingles(group.column("text").to_pylist())
    weight = factor[(code % np.uint64(SKETCH)).astype(np.int64)]
    total = np.bincount(owner, count * weight, minlength=len(node))
    # A shingle that occurs n times is n features of the same weight: shared ones add up to the smaller count.
    level = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    feature, owner, weight = mixed(np.repeat(code, count) + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.repeat(owner, count), np.repeat(weight, count)
    of = [side[owner] == 0, side[owner] == 1]
    shared = np.intersect1d(feature[of[0]], feature[of[1]])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    place = np.empty(len(node), np.int64)
    place[left], place[right] = np.arange(len(left)), np.arange(len(right))
    low = np.zeros((len(left), len(right)), np.float32)
    at = np.searchsorted(shared, feature)
    hit = (at < len(shared)) & (shared[np.minimum(at, max(len(shared) - 1, 0))] == feature) if len(shared) else np.zeros(len(feature), bool)
    for k in range(0, len(shared), STEP):
        mats = []
        for s, n in ((0, len(left)), (1, len(right))):
            here = hit & of[s] & (at >= k) & (at < k + STEP)
            mat = np.zeros((n, min(STEP, len(shared) - k)), np.float32)
            mat[place[owner[here]], at[here] - k] = weight[here] if s == 0 else 1
            mats.append(mat)
        low += mats[0] @ mats[1].T
    value = low / np.maximum(total[left][:, None] + total[right][None, :] - low, 1e-9)
    apart = component[left][:, None] != component[right][None, :]
    i, j = np.nonzero((value >= similar - 1e-4) & apart)
    close = np.abs(value[i, j] - similar) <= 1e-4
    if close.any():
        texts = group.column("text")

        def weighed(r: int):
            c, n, _, _ = shingles([texts[r].as_py()])
            return c, weights(c, n, factor)

        exact = [similarity(weighed(int(left[x])), weighed(int(right[y]))) >= similar for x, y in zip(i[close], j[close])]
        keep = np.ones(len(i), bool)
        keep[close] = exact
        i, j = i[keep], j[keep]
    parent = hook(np.arange(len(node)), left[i], right[j])
    moved = np.flatnonzero(parent != np.arange(len(node)))
    return pa.Table.from_arrays([pa.array(node[moved], pa.int64()), pa.array(node[parent[moved]], pa.int64())], ["a", "b"])


def _components(links: DataFrame) -> DataFrame:
    found = connected_components(links, "a", "b")
    return found.select(F.col("vertex").alias("node"), "component")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text_hash, class_id, first)``, one row per row of ``docs``.

    ``class_id``: least id among the documents reachable by links of weighted Jaccard at least 0.8; ``first``: the row is the class's first
    by (id, hash of the text); repeated rows tie. ``text_hash``: ``xxhash64`` of the text. Null and empty texts link with nothing and are their own
    class; of texts without words only equal ones form a class. A null id comes last; other columns are ignored; an empty table gives an empty result. Missed: pairs that share no band, at similarity 0.8 about
    one in twenty thousand, and pairs with too few equal draws (``AGREE``).
    """
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(rarity(docs, text_col))  # one number per sketch bucket
    marked = cut(signatures(docs, idf, id_col, text_col), "signatures")
    by_id = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    grouped = marked.filter("word_key is not null").groupBy("word_key").agg(F.min(by_id).alias("first"), F.first("draws").alias("draws"))
    # Numbered once and written, so that every later step sees the same numbers.
    nodes = cut(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = cut(_leaders(bands(nodes.filter("draws is not null"))), "buckets")
    pairs = members.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    agreeing = cut(_agreeing(pairs, nodes), "pairs")
    wanted = members.select("node").distinct().join(nodes.select("node", "first"), "node")
    keyed = wanted.select("node", F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash"))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    match = source["id"].eqNullSafe(keyed["id"]) & (source["text_hash"] == keyed["text_hash"])
    texts = cut(source.join(keyed, match).select("node", "text").dropDuplicates(["node"]), "texts")
    links = cut(verified(agreeing, texts, idf), "links")
    component = cut(_components(links), "components")
    more = cut(_remaining(members, links, component, nodes, texts, idf), "links")
    if not more.isEmpty():
        component = cut(_components(links.union(more)), "components")
    named = nodes.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    class_of = named.join(least, "component").select("word_key", "least")
    out = marked.select("id", "text_hash", "word_key").join(class_of, "word_key", "left")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    return out.select(
        F.col("id").alias(id_col),
        "text_hash",
        F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("class_id"),
        (F.col("least").isNull() | (own == F.col("least"))).alias("first"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: its first; rows that repeat in id and text count as one."""
    first = classes(docs, id_col, text_col).filter("first").select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash"))
    keyed = docs.withColumn("_own", F.xxhash64(text_col))
    kept = keyed.join(first, keyed[id_col].eqNullSafe(first["_id"]) & (keyed["_own"] == first["_hash"]), "left_semi")
    return kept.dropDuplicates([id_col, "_own"]).drop("_own")

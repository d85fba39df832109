"""Phrase collocations by sorting suffix pointers, routed over the cluster by their leading words.

A suffix is a word and at most the four that follow it in its piece; its words are named by 64-bit hashes of language and word. Words are
counted first, then pairs of frequent neighbours, each over the whole corpus; a suffix ends where a pair is not frequent. Suffixes are routed by their leading words to buckets,
and in a bucket multikey three-way quicksort orders pointers to them: the size of a partition of equal leading words is the phrase's count, and
a partition with less weight than the least count is abandoned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netquant.lineage import cut
from netquant.llm.features import mixed

#: Words of the longest phrase.
DEPTH = 5
#: Bytes of text handled at once, and suffixes that a bucket holds on average; both only bound memory.
CHUNK, BUCKET = 8_000_000, 500_000
#: Most bits of a sieve. A fuller sieve lets more rare neighbours through to the sort, which abandons them.
SIEVE_BITS = 1 << 27
#: Signs that end a piece, and the other blank.
PIECE_ENDS, TAB = b".,;:!?\n\x0b\x0c\r", b"\t"

PLAIN = bytes(10 if c in PIECE_ENDS else 32 if c in TAB else c + 32 if 65 <= c <= 90 else c for c in range(256))
SEPARATOR = re.compile(rb"[ \n]")
LOOKAHEAD = re.compile(rb" *(?:[^ \n]+ *){0,%d}" % (DEPTH - 1))


def segments(text: bytes) -> Iterator[tuple[bytes, int]]:
    """Plain text in parts, with the bytes of each that are its own; a long text's part also shows the words after it."""
    plain, first = text.translate(PLAIN), 0
    while len(plain) - first > CHUNK:
        end = SEPARATOR.search(plain, first + CHUNK // 2)
        if end is None:
            break
        yield plain[first : LOOKAHEAD.match(plain, end.start()).end()], end.start() - first
        first = end.start()
    yield plain[first:], len(plain) - first


class Words:
    """Words of a run of segments as arrays over their positions."""

    def __init__(self, held: list[tuple[bytes, int, str]]) -> None:
        data = b"\n".join([part for part, _, _ in held]) + b"\n"
        signs = np.frombuffer(data, np.uint8)
        blank = (signs == 32) | (signs == 10)
        at = np.flatnonzero(np.concatenate([[True], blank[1:] != blank[:-1]]))
        offsets = np.append(at, len(data)).astype(np.int32)
        wanted = ~blank[at]
        start = at[wanted]
        runs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = runs.filter(pa.array(wanted)).dictionary_encode()
        self.text: list[bytes] = coded.dictionary.to_pylist()
        self.index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.array([len(part) + 1 for part, _, _ in held])
        before = np.cumsum(sizes) - sizes
        segment = np.searchsorted(before, start, side="right") - 1
        self.own = start - before[segment] < np.array([own for _, own, _ in held])[segment]
        names = sorted({lang for _, _, lang in held})
        self.langs = names
        self.lang = np.array([names.index(lang) for _, _, lang in held])[segment]
        salt = np.array([xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"), 1) for name in names], np.uint64)
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, self.text), np.uint64, len(self.text))
        self.id = np.maximum(mixed(hashed[self.index] ^ salt[self.lang]), np.uint64(1)) if len(start) else np.empty(0, np.uint64)
        piece = np.cumsum(signs == 10)[start]
        #: The next word stands in the same piece.
        self.followed = np.append(piece[1:] == piece[:-1], False) if len(start) else np.empty(0, bool)

    def pairs(self) -> np.ndarray:
        """Name of each word with the next one."""
        after = np.append(self.id[1:], np.uint64(0)) if len(self.id) else self.id
        return mixed(self.id * np.uint64(0xD6E8FEB86659FD93) + after)


def word_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    held, size = [], 0
    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
            for part, own in segments(text.as_py()):
                held.append((part, own, lang))
                size += len(part)
                if size >= CHUNK:
                    yield Words(held)
                    held, size = [], 0
    if held:
        yield Words(held)


def sieve(names: DataFrame, column: str) -> np.ndarray:
    """Bits of the names, 16 or more for each up to ``SIEVE_BITS``: a name whose bit is not set is not among them."""
    n = names.count()
    bits = int(min(max(1 << 15, 1 << (16 * n).bit_length()), SIEVE_BITS))
    spot = F.col(column).bitwiseAND(F.lit(bits - 1))
    placed = names.select(F.shiftright(spot, 15).alias("part"), spot.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")).distinct()

    def pack(group: pa.Table) -> pa.Table:
        flags = np.zeros(1 << 15, np.uint8)
        flags[group.column("bit").to_numpy()] = 1
        return pa.table({"part": group.column("part").slice(0, 1), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(bits >> 3, np.uint8)
    for row in placed.groupBy("part").applyInArrow(pack, "part long, bits binary").collect():  # at most SIEVE_BITS in all
        out[row["part"] << 12 : (row["part"] + 1) << 12] = np.frombuffer(row["bits"], np.uint8)
    return out


def passes(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    spot = (names & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return ((bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1).astype(bool)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def count_words(texts: DataFrame) -> DataFrame:
    """``(id, lang, word, n)`` of every word of every language; a task sends one row per word and run of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in word_runs(batches):
            k = len(w.langs)
            code, first, n = np.unique((w.index * k + w.lang)[w.own], return_index=True, return_counts=True)
            word = [w.text[c] for c in (code // k).tolist()]
            lang = pa.array(w.langs, pa.string()).take(pa.array(code % k))
            yield pa.RecordBatch.from_arrays([_longs(w.id[w.own][first]), lang, pa.array(word, pa.binary()), pa.array(n)], ["id", "lang", "word", "n"])

    counted = texts.mapInArrow(run, "id long, lang string, word binary, n long")
    return counted.groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))


def count_pairs(texts: DataFrame, words: Broadcast) -> DataFrame:
    """``(pair, n)`` of neighbours in a piece that are both frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in word_runs(batches):
            known = passes(words.value, w.id)
            here = w.own & w.followed & known & np.append(known[1:], False) if len(known) else known
            name, n = np.unique(w.pairs()[here], return_counts=True)
            yield pa.RecordBatch.from_arrays([_longs(name), pa.array(n)], ["pair", "n"])

    return texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def suffixes(texts: DataFrame, words: Broadcast, pairs: Broadcast, buckets: int) -> DataFrame:
    """``(bucket, suffix, n)``: equal suffixes of a run of text as one row.

    Suffixes of three words or more go by their first three words; for the counts of pairs each suffix also goes cut to two, by these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in word_runs(batches):
            if not len(w.id):
                continue
            known, pair = passes(words.value, w.id), w.pairs()
            joined = w.followed & known & np.append(known[1:], False) & passes(pairs.value, pair)
            at = np.flatnonzero(joined & w.own)
            name, first, n = np.unique(pair[at], return_index=True, return_counts=True)
            short = np.zeros((len(name), DEPTH), np.uint64)
            short[:, 0], short[:, 1] = w.id[at[first]], w.id[at[first] + 1]
            yield _rows(name % np.uint64(buckets), short, n)
            ends = np.append(joined, np.zeros(DEPTH, bool))
            at = at[ends[at + 1]]
            full = np.zeros((len(at), DEPTH), np.uint64)
            alive = np.ones(len(at), bool)
            route, whole = pair[at], pair[at]
            padded = np.append(w.id, np.zeros(DEPTH, np.uint64))
            for d in range(DEPTH):
                if d > 1:
                    alive = alive & ends[at + d - 1]
                full[:, d] = np.where(alive, padded[at + d], np.uint64(0))
                if d > 1:
                    whole = mixed(whole * np.uint64(0x100000001B3) + full[:, d])
                if d == 2:
                    route = whole
            _, first, n = np.unique(whole, return_index=True, return_counts=True)
            yield _rows(route[first] % np.uint64(buckets), full[first], n)

    return texts.mapInArrow(run, "bucket long, suffix binary, n long")


def _rows(bucket: np.ndarray, full: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(full) + 1, dtype=np.int32) * np.int32(8 * DEPTH)
    packed = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(full).tobytes())])
    return pa.RecordBatch.from_arrays([_longs(bucket), packed, pa.array(n.astype(np.int64))], ["bucket", "suffix", "n"])


def quicksorted(suffix: np.ndarray, n: np.ndarray, least: int) -> list[tuple[bytes, int]]:
    """Phrases of at least ``least`` occurrences, by multikey three-way quicksort of pointers to the suffixes.

    ``suffix``: words by position, 0 after a suffix's end; rows of two words count pairs, longer ones longer phrases.
    """
    out: list[tuple[bytes, int]] = []
    todo = [(np.arange(len(n)), 0)] if n.sum() >= least else []
    while todo:
        at, depth = todo.pop()
        key = suffix[at, depth]
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        less, equal = key < pivot, key == pivot
        for side in (at[less], at[~(less | equal)]):
            if n[side].sum() >= least:
                todo.append((side, depth))
        same = at[equal]
        count = int(n[same].sum())
        if count < least:
            continue
        if pivot == 0:
            if depth == 2:
                out.append((suffix[same[0], :2].tobytes(), count))
            continue
        if depth >= 2:
            out.append((suffix[same[0], : depth + 1].tobytes(), count))
        if depth + 1 < DEPTH:
            todo.append((same, depth + 1))
    return out


def frequent_phrases(texts: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """``(phrase, a)``: phrases of two to five words, as the names of their words, with at least ``least`` occurrences."""
    spark = texts.sparkSession
    known = spark.sparkContext.broadcast(sieve(words, "id"))
    pairs = cut(count_pairs(texts, known).filter(F.col("n") >= least), "word-pairs")
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = spark.sparkContext.broadcast(sieve(pairs, "pair"))
    routed = suffixes(texts, known, joined, max(1, -(-total // BUCKET)))

    def sort(group: pa.Table) -> pa.Table:
        suffix = np.frombuffer(b"".join(group.column("suffix").to_pylist()), np.uint64).reshape(-1, DEPTH)
        found = quicksorted(suffix, group.column("n").to_numpy(), least)
        return pa.table({"phrase": pa.array([p for p, _ in found], pa.binary()), "a": pa.array([a for _, a in found], pa.int64())})

    return routed.groupBy("bucket").applyInArrow(sort, "phrase binary, a long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, first: int | None = 2000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)`` of the collocations of each language, the best ``first`` of them (None: all).

    A-Z are lower-cased; ``PIECE_ENDS`` cut a text into pieces, blanks and tabs those into words. ``n``: words of the language; ``a``: occurrences of
    the phrase, at least ``least``; ``l``, ``r``: those of its parts at the cut with the lowest score floor(1000 a n / (l r)), the first such cut. Phrases
    that lie in a longer one of as many occurrences are left out. Null texts are empty, null languages ``und``; repeated rows count each; other columns
    are ignored; an empty table gives an empty result. Words are told apart by 64-bit hashes of language and word.
    """
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    words = cut(count_words(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    words = words.filter(F.col("n") >= least)
    phrases = cut(frequent_phrases(texts, words, least), "phrases")
    return _ranked(_scored(phrases, cut(_named(words), "word-names"), totals), first)


def _named(words: DataFrame) -> DataFrame:
    """``(name, lang, word, n)``: the eight bytes that stand for a word in a phrase, the lowest first."""
    digits = F.lpad(F.hex("id"), 16, "0")
    pairs = [F.substring(digits, 15 - 2 * i, 2) for i in range(8)]
    return words.select(F.unhex(F.concat(*pairs)).alias("name"), "lang", F.col("word").cast("string").alias("word"), "n")


def _scored(phrases: DataFrame, names: DataFrame, totals: DataFrame) -> DataFrame:
    size = (F.length("phrase") / 8).cast("int")
    counts = phrases.select(F.col("phrase").alias("part"), F.col("a").alias("f")).union(names.select("name", "n"))
    sized = phrases.withColumn("size", size)
    piece = lambda start, words: F.expr(f"substring(phrase, 8 * ({start}) + 1, 8 * ({words}))")
    inside = sized.filter("size > 2").withColumn("length", F.explode(F.expr("sequence(2, size - 1)")))
    inside = inside.withColumn("start", F.explode(F.expr("sequence(0, size - length)"))).select(piece("start", "length").alias("phrase"), "a")
    covered = inside.groupBy("phrase").agg(F.max("a").alias("longer"))
    kept = sized.join(covered, "phrase", "left").filter("longer is null or longer < a").drop("longer")
    spelled = (
        kept.select("phrase", "a", "size", F.posexplode(F.transform(F.expr("sequence(0, size - 1)"), lambda i: F.substring("phrase", 8 * i + 1, F.lit(8)))).alias("at", "name"))
        .join(names.select("name", "lang", "word"), "name")
        .groupBy("phrase", "a", "size", "lang")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("text"))
    )
    cuts = spelled.join(totals, "lang").withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.withColumns({"left": piece("0", "k"), "right": piece("k", "size - k")})
    left, right = (counts.select(F.col("part").alias(side), F.col("f").alias(out)) for side, out in (("left", "l"), ("right", "r")))
    # Products of counts need up to 128 bits.
    exact = F.expr("1000 * cast(a as decimal(15,0)) * cast(total as decimal(18,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cuts.join(left, "left").join(right, "right").withColumn("score", exact.cast("long"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return scored.groupBy("lang", "phrase", "text", "a", "total").agg(best)


def _ranked(scored: DataFrame, first: int | None) -> DataFrame:
    rows = scored.select("lang", F.col("text").alias("phrase"), "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("total").alias("n"), F.col("best.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if first is not None:
        ranked = ranked.filter(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

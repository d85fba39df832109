"""BPE encoding and decoding by tree concatenation.

A document of more than ``leaf_chars`` code points is cut into leaves that other tasks encode in
parallel. Where the text has a place at which a pre-token surely begins the
leaves are independent; where it has none (long unsplit text) the cut lies inside one pre-token and
neighbouring leaves are joined in a tree: growing windows around each join are encoded again until both
sides agree exactly (:func:`netquant.llm.tokens.concatenate`).
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
from netquant.llm.tokens import BLANK, END, LETTER, OTHER, SPACE, UNKNOWN, classes, concatenate, vocabulary

BATCH_BYTES = 8_000_000


def encode(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = 1 << 16
) -> DataFrame:
    """``(id_col, ids array<int>)``, one row for each row of ``docs``.

    ``tokenizer`` is the path of a byte-level BPE file of the ``tokenizers`` library, readable on every
    executor. Null and empty text give an empty array. Repeated rows give repeated rows, a null id stays
    null, other columns are ignored whatever their names, an empty table gives an empty result. No special
    token is added; the string of one in a text becomes its id, as the library does.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    long = F.length("text") > leaf_chars
    short_ids = rows.filter(~long).mapInArrow(_encode_rows(tokenizer), schema)
    long_ids = _encode_long(rows.filter(long), tokenizer, leaf_chars, schema)
    return short_ids.union(long_ids).withColumnRenamed("id", id_col)


def _encode_rows(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            ids = vocab.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(ids)], ["id", "ids"])

    return run


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    values = np.concatenate([np.empty(0, "<u4"), *ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


LEAF = "id {id}, text_key string, leaf long, inside boolean, opened boolean, whole boolean, text string"
CODED = "id {id}, text_key string, leaf long, inside boolean, first long, last long, ids binary"


def _encode_long(rows: DataFrame, tokenizer: str, leaf_chars: int, schema: T.StructType) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    leaves = rows.mapInArrow(_cut_rows(tokenizer, leaf_chars), LEAF.format(id=kind))
    # Leaves of one document are dealt out; only long documents move.
    dealt = leaves.repartition(F.col("text_key"), F.col("leaf"))
    coded = dealt.mapInArrow(_encode_leaves(tokenizer), CODED.format(id=kind))
    return coded.groupBy("id", "text_key").applyInArrow(_join_leaves(tokenizer, schema), schema)


def leaf_cuts(kind: np.ndarray, leaf_chars: int, words_only: bool) -> list[tuple[int, bool]]:
    """Starts of leaves after the first; True where the cut lies inside one pre-token.

    The last place in the second half of a leaf where a pre-token surely begins: another class begins, but neither after
    white space (a blank goes with what follows) nor a letter after a sign (a short form may begin before it). Without one, one
    class fills most of the leaf and the cut lies inside it, three signs from its ends.
    """
    run = np.where(kind == BLANK, SPACE, kind)
    cuts: list[tuple[int, bool]] = []
    begin, n = 0, len(run)
    while n - begin > leaf_chars:
        low, high = begin + leaf_chars // 2, begin + leaf_chars
        before, here = run[low - 1 : high - 1], run[low:high]
        sure = (before != here) & (before != SPACE) & ~((before == OTHER) & (here == LETTER))
        places = np.flatnonzero(sure)
        if len(places):
            at, inside = low + int(places[-1]), False
        else:
            around = [run[low + i : high + i] if high + i <= n else np.append(run[low + i :], END) for i in (-3, -2, -1, 0, 1)]
            same = np.flatnonzero(np.all([x == around[3] for x in around], axis=0))
            at = low + int(same[-1])
            inside = not words_only or bool(run[at] in (LETTER, OTHER))
        cuts.append((at, inside))
        begin = at
    return cuts


def _cut_rows(tokenizer: str, leaf_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            docs, out = [], [[] for _ in types]
            for doc, raw in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                key = hashlib.sha256(raw.encode("utf-8", "surrogatepass")).hexdigest()
                text = vocab.prepared(raw)
                kind = classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
                whole = vocab.has_special(raw) or bool((kind == UNKNOWN).any())
                cuts = [] if whole else leaf_cuts(kind, leaf_chars, vocab.words_only)
                text = raw if whole else text
                begins, ends = [(0, False), *cuts], [*cuts, (len(text), False)]
                for leaf, ((begin, inside), (end, opened)) in enumerate(zip(begins, ends)):
                    docs.append(doc)
                    for column, value in zip(out, (key, leaf, inside, opened, whole, text[begin:end])):
                        column.append(value)
            arrays = [pa.array(docs, batch.column("id").type), *(pa.array(v, t) for v, t in zip(out, types))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "text_key", "leaf", "inside", "opened", "whole", "text"])

    return run


def _encode_leaves(tokenizer: str):
    """Ids of each leaf and how many of them belong to its first and last pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for batch in byte_batches(batches, "text", BATCH_BYTES):
            texts, opened, whole = (batch.column(c).to_pylist() for c in ("text", "opened", "whole"))
            coded = [(vocab.encode([t])[0], 0, 0) if w else vocab.encode_leaf(t, o) for t, o, w in zip(texts, opened, whole)]
            ids, first, last = zip(*coded)
            kept = [batch.column(c) for c in ("id", "text_key", "leaf", "inside")]
            new = [pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([*kept, *new], ["id", "text_key", "leaf", "inside", "first", "last", "ids"])

    return run


def _join_leaves(tokenizer: str, schema: T.StructType):
    """All leaves of one document; repeated documents send each leaf as many times."""

    def run(group: pa.Table) -> pa.Table:
        vocab = vocabulary(tokenizer)
        rows = sorted(group.to_pylist(), key=lambda r: r["leaf"])
        copies = sum(r["leaf"] == 0 for r in rows)
        parts = [(np.frombuffer(r["ids"], "<u4").tolist(), r["first"], r["last"], r["inside"]) for r in rows[::copies]]
        ids = np.array(join_leaves(vocab, parts), "<u4")
        return pa.Table.from_arrays(
            [pa.array([rows[0]["id"]] * copies, group.schema.field("id").type), _lists([ids] * copies)], ["id", "ids"]
        )

    return run


def join_leaves(vocab, parts: list[tuple[list[int], int, int, bool]]) -> list[int]:
    """Join neighbouring parts level by level. A part: ids, ids of its first and last pre-token, begins inside one."""
    while len(parts) > 1:
        level = []
        for a, b in zip(parts[::2], parts[1::2]):
            level.append(_join_two(vocab, a, b))
        parts = level + parts[len(level) * 2 :]
    return parts[0][0] if parts else []


def _join_two(vocab, a, b):
    (left, left_first, left_last, inside), (right, right_first, right_last, joined) = a, b
    if not joined or not left or not right:
        return [*left, *right], left_first or right_first, right_last or left_last, inside
    seam = concatenate(vocab.merge_bytes, vocab.bytes_of, left[len(left) - left_last :], right[:right_first])
    ids = [*left[: len(left) - left_last], *seam, *right[right_first:]]
    # Where a side is one pre-token, the joined one reaches through it.
    first = len(seam) if left_first == len(left) and left_last == len(left) else left_first
    last = len(seam) if right_first == len(right) and right_last == len(right) else right_last
    return ids, first, last, inside


def decode(coded: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """Add the text of ``ids_col``; null ids give the empty text, bytes that are no UTF-8 the replacement sign."""
    schema = T.StructType([*(f for f in coded.schema if f.name != out), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for batch in batches:
            names = [n for n in batch.schema.names if n != out]
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [vocab.decode(x) if x else "" for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string())], [*names, out])

    return coded.mapInArrow(run, schema)

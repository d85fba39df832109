"""Vectorised encoding of text batches with a public BPE vocabulary.

Byte pair encoding only sees one pre-token at a time and corpora repeat their words, so a batch of
texts is cut into pre-tokens with array operations, equal pre-tokens are counted once, and only
words that the worker has not met yet are merged. A pre-token longer than ``LONG`` bytes is encoded
by tree concatenation (:func:`tree_encode`).

The ids are those of the ``tokenizers`` library for byte-level BPE files of two kinds: with the
contraction, letter, digit and sign pattern that keeps white space, and with word ends
(``end_of_word_suffix``) on lower-case text that drops it. Texts that hold the string of a special
token, or code points that this Python's Unicode tables don't assign, are handed to the library itself.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

#: Bytes of a pre-token beyond which it is encoded in halves.
LONG = 512
#: Code points handled at once, and words that a worker keeps; both only bound memory.
CHUNK, KEPT = 500_000, 200_000

OTHER, LETTER, NUMBER, SPACE, BLANK, END, UNKNOWN = range(7)
#: The code points of the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: Stands for the end of a word; no UTF-8 text holds this byte.
WORD_END = b"\xff"


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, the blank U+0020, other, unassigned."""
    kinds = {"L": LETTER, "N": NUMBER}
    names = [unicodedata.category(chr(c)) for c in range(0x110000)]
    table = np.array([UNKNOWN if n == "Cn" else kinds.get(n[0], OTHER) for n in names], np.uint8)
    table[WHITE_SPACE] = SPACE
    table[32] = BLANK
    return table


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """One tokenizer file, its merges, and the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_letters()
        suffix = model.get("end_of_word_suffix") or ""
        self.path, self.words_only = path, bool(suffix)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(max(model["vocab"].values()), *self.specials.values())
        self.bytes_of: list[bytes] = [b""] * size
        ranks = {}
        for token, i in model["vocab"].items():
            if token in self.specials:
                continue
            end = self.words_only and token.endswith(suffix)
            raw = bytes(letters[c] for c in (token[: -len(suffix)] if end else token))
            self.bytes_of[i] = raw + (WORD_END if end else b"")
            ranks[self.bytes_of[i]] = i
        for content, i in self.specials.items():
            self.bytes_of[i] = content.encode()
        self._merge = tiktoken.Encoding("own", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._known: dict[bytes, bytes] = {}

    @property
    def library(self) -> Tokenizer:
        return _library(self.path)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if self.words_only:
            piece += WORD_END
        return tree_encode(self._merge, self.bytes_of, piece) if len(piece) > LONG else self._merge(piece)

    def merge_bytes(self, piece: bytes) -> list[int]:
        """Ids of bytes inside one pre-token, as they are; the end of a word comes with its bytes."""
        return self._merge(piece)

    def encode_leaf(self, text: str, opened: bool = False) -> tuple[np.ndarray, int, int]:
        """Ids of prepared text and how many of them its first and last pre-token have.

        ``opened``: the last pre-token goes on in the next leaf, so it has no word end yet.
        """
        pieces, _, _ = split_words([text], self.words_only)
        if not len(pieces):
            return np.empty(0, "<u4"), 0, 0
        tail = pieces[-1].as_py() if opened else b""
        coded = (pieces[:-1] if opened else pieces).dictionary_encode()
        words = self.packed(coded.dictionary.to_pylist())
        packed = [words[i] for i in coded.indices.to_pylist()]
        if opened:
            packed.append(array("I", tree_encode(self._merge, self.bytes_of, tail)).tobytes())
        return np.frombuffer(b"".join(packed), "<u4"), len(packed[0]) // 4, len(packed[-1]) // 4

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def prepared(self, text: str) -> str:
        """What the file's normaliser makes of the text, as far as it changes pre-tokens."""
        if not self.words_only:
            return text
        if not text.isascii():
            # Letters are lowered one by one, so a sigma at a word's end is no final sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def packed(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as 32-bit integers."""
        known, merge, end = self._known, self._merge, WORD_END if self.words_only else b""
        if len(known) + len(words) > KEPT:
            known.clear()
        out = list(map(known.get, words))
        for at, ids in enumerate(out):
            if ids is None:
                word = words[at]
                if len(word) < LONG:
                    out[at] = known[word] = array("I", merge(word + end)).tobytes()
                else:
                    out[at] = array("I", self.merge(word)).tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text; null counts as empty."""
        out: list[np.ndarray] = [np.empty(0, "<u4")] * len(texts)
        chunk: list[tuple[int, str]] = []
        held = 0
        for at, text in enumerate(texts):
            if not text:
                continue
            if "<" in text and self.has_special(text):
                out[at] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
                continue
            chunk.append((at, self.prepared(text)))
            held += len(text)
            if held >= CHUNK:
                self._encode_chunk(chunk, out)
                chunk, held = [], 0
        if chunk:
            self._encode_chunk(chunk, out)
        return out

    def _encode_chunk(self, chunk: list[tuple[int, str]], out: list[np.ndarray]) -> None:
        pieces, doc_of, unknown = split_words([t for _, t in chunk], self.words_only)
        coded = pieces.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        packed = self.packed(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(packed), "<u4")
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        first = np.cumsum(size) - size
        counts = size[index]
        before = np.cumsum(counts) - counts
        total = int(counts.sum())
        ids = flat[np.arange(total) + np.repeat(first[index] - before, counts)]
        bounds = np.searchsorted(doc_of, np.arange(len(chunk) + 1))
        ends = np.append(before, total)[bounds]
        for (at, _), lo, hi in zip(chunk, ends[:-1], ends[1:]):
            out[at] = ids[lo:hi]
        for k in unknown:
            at, text = chunk[k]
            out[at] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become the replacement sign."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def _library(path: str) -> Tokenizer:
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    return library


def split_words(texts: list[str], words_only: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pre-tokens of all texts as one binary array, the text that each belongs to, texts with unassigned signs."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind = classes()[points]
    kind[ends] = END
    start = starts(points, kind, words_only)
    width = np.ones(len(points), np.uint8)
    if not joined.isascii():
        for limit in (0x80, 0x800, 0x10000):
            width += points >= limit
    byte_at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    at = np.flatnonzero(start)
    wanted = kind[at] != END
    if words_only:
        wanted &= (kind[at] != SPACE) & (kind[at] != BLANK)
    offsets = byte_at[np.append(at, len(points))].astype(np.int32)
    data = joined.encode("utf-8", "surrogatepass")
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    unknown = np.unique(np.searchsorted(ends, np.flatnonzero(kind == UNKNOWN)))
    return pieces.filter(pa.array(wanted)), np.searchsorted(ends, at[wanted]), unknown


def starts(points: np.ndarray, kind: np.ndarray, words_only: bool) -> np.ndarray:
    """Where a pre-token begins, as a mask over code points."""
    run = np.where(kind == BLANK, SPACE, kind)
    start = np.ones(len(points), bool)
    start[1:] = run[1:] != run[:-1]
    if words_only:
        start |= kind == NUMBER
    else:
        # The last blank before a word goes with it; other white space there stands alone.
        last = np.flatnonzero((run[:-1] == SPACE) & (run[1:] != SPACE) & (run[1:] != END))
        start[last] = True
        start[last[kind[last] == BLANK] + 1] = False
    quotes = np.flatnonzero((points[:-1] == ord("'")) & start[:-1])
    if len(quotes):
        padded = np.append(points, [0, 0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        for at, size in ((quotes[short], 2), (quotes[long], 3)):
            start[at + 1] = False
            start[at + size] = True
    return start


def tree_encode(merge, bytes_of: list[bytes], piece: bytes, leaf: int = LONG) -> list[int]:
    """Ids of one long pre-token: leaves are merged on their own, neighbours joined level by level."""
    size = max(leaf, 2)
    nodes = [merge(piece[i : i + size]) for i in range(0, len(piece), size)]
    while len(nodes) > 1:
        joined = [concatenate(merge, bytes_of, a, b) for a, b in zip(nodes[::2], nodes[1::2])]
        nodes = joined + nodes[len(joined) * 2 :]
    return nodes[0]


def concatenate(merge, bytes_of: list[bytes], left: list[int], right: list[int]) -> list[int]:
    """Encoding of the text of two encodings that lie within one pre-token.

    The last and first ``k`` ids around the join are encoded again from their bytes. If that begins
    with the same id as the left window and ends with the same id as the right one, every pair of
    neighbouring ids in the whole is a pair of a true encoding; by the pair property of merges in
    a fixed order the whole then is the encoding. Otherwise the window doubles; once it holds all
    of a side there is nothing left to agree with on that side.
    """
    if not left or not right:
        return [*left, *right]
    k = 4
    while True:
        a, b = left[-k:], right[:k]
        again = merge(b"".join(bytes_of[i] for i in [*a, *b]))
        if (k >= len(left) or again[0] == a[0]) and (k >= len(right) or again[-1] == b[-1]):
            return [*left[: max(0, len(left) - k)], *again, *right[k:]]
        k *= 2

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netquant.lineage import cut
from netquant.llm import bpe, counts, packing, queries
from netquant.llm.tokens import concatenate, vocabulary

SF = "/root/testdata/sf0.001"
PATHS = [P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")]


def expected(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts(n=3000):
    rng = random.Random(3)
    signs = "ab's 'RE're'll  \n\t !?'é İΣσς12½Ⅷ漢字😀é \x1c\x85-_<|>Ᲊ"
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("path", PATHS)
def test_batch_ids_equal_the_library(path):
    texts = [*odd_texts(), "a" * 3000, "ab" * 2000 + "!" * 1500, " " * 2000 + "x", "x<|endoftext|>y", None, ""]
    assert [x.tolist() for x in vocabulary(path).encode(texts)] == expected(path, texts)


def test_concatenation_of_any_halves_is_the_encoding():
    vocab, rng = vocabulary(PATHS[0]), random.Random(1)
    for _ in range(400):
        piece = "".join(rng.choice(["the", "ing", "a", "an", "t", "e", "xx"]) for _ in range(rng.randint(2, 60))).encode()
        at = rng.randint(1, len(piece) - 1)
        merged = concatenate(vocab.merge_bytes, vocab.bytes_of, vocab.merge_bytes(piece[:at]), vocab.merge_bytes(piece[at:]))
        assert merged == vocab.merge_bytes(piece)


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("leaf", [64, 1000])
def test_leaves_join_to_the_whole(spark, odd_docs, path, leaf):
    rows = bpe.encode(odd_docs, path, leaf_chars=leaf).collect()
    texts = odd_docs.select("doc_id", "text").collect()
    want = sorted((str(r["doc_id"]), ids) for r, ids in zip(texts, expected(path, [r["text"] for r in texts])))
    assert sorted((str(r["doc_id"]), r["ids"]) for r in rows) == want


def test_cuts_at_any_place_keep_ids(spark):
    rng, path = random.Random(9), PATHS[0]
    texts = ["".join(rng.choice(["'s", "'ll", "ab", "  ", " ", "\n", "1", "!", "'", "é"]) * rng.randint(1, 9) for _ in range(120)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for p in PATHS:
        rows = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, p, leaf_chars=40).collect()}
        assert [rows[i] for i in range(len(texts))] == expected(p, texts)


def test_decode_gives_the_text_back(spark, odd_docs, no_docs):
    coded = bpe.encode(odd_docs, PATHS[0])
    got = bpe.decode(coded, PATHS[0]).select("doc_id", "text").collect()
    assert sorted(map(str, got)) == sorted(map(str, odd_docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))
    assert bpe.encode(no_docs, PATHS[0]).count() == 0


def test_op2_digests(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op2(spark, SF).collect()}
    assert len(got) == len(docs)
    for r, ids in zip(docs, expected(PATHS[0], [r["text"] for r in docs])):
        row = got[r["doc_id"]]
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == sha(",".join(map(str, ids)))
        assert row["decoded_sha256"] == sha(r["text"] or "")


def test_suffix_sums_against_counting(spark, odd_docs, no_docs):
    limits = [1, 7, 100, 10**6]
    lengths = [len(x) for x in expected(PATHS[0], [r["text"] for r in odd_docs.collect()])]
    sums = cut(counts.suffix_sums(cut(counts.length_histogram(odd_docs, PATHS[0])), limits))
    rows = sums.collect()
    assert sorted(r["context_limit"] for r in rows) == sorted(set(lengths) | set(limits))
    for r in rows:
        c = r["context_limit"]
        assert r["n_docs"] == lengths.count(c) and r["docs_from"] == sum(x >= c for x in lengths)
        assert r["tokens_from"] == sum(x for x in lengths if x >= c) and r["docs_below"] == sum(x < c for x in lengths)
        assert r["truncated_tokens"] == sum(min(x, c) for x in lengths)
        assert r["dropped_tokens"] == sum(max(0, x - c) for x in lengths)
        assert r["share_within"] == pytest.approx(sum(x <= c for x in lengths) / len(lengths))
    assert counts.truncated_total(sums, 333).first()[0] == sum(min(x, 333) for x in lengths)
    assert counts.quantile(sums, 0.5).first()[0] == sorted(lengths)[(len(lengths) - 1) // 2]
    assert counts.suffix_sums(counts.length_histogram(no_docs, PATHS[0])).count() == 0


def test_op3_reads_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    lengths = [len(x) for x in expected(PATHS[0], [r["text"] for r in docs])]
    rows = queries.op3(spark, SF).collect()
    assert sum(r["n_docs"] for r in rows) == len(lengths) and sum(r["tokens"] for r in rows) == sum(lengths)
    assert all(r["truncated_tokens"] == sum(min(x, r["context_limit"]) for x in lengths) for r in rows)


def check_packing(rows, window):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(by_sequence) * window / max(1, sum(r["length"] for r in rows)) - 1


def test_op7_pieces_cover_each_document_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = {r["doc_id"]: [*x, 2] for r, x in zip(docs, expected(PATHS[1], [r["text"] for r in docs]))}
    rows = queries.op7(spark, SF).collect()
    for doc, whole in ids.items():
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"]):
            part = np.array(whole[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(whole)
            at += r["length"]
        assert at == len(whole)
    assert check_packing(rows, 4096) < 0.08


@pytest.mark.parametrize("kind", ["one length", "short", "mixed", "large"])
def test_packing_is_tight(spark, kind):
    rng = np.random.default_rng(4)
    lengths = {
        "one length": [1000] * 3000,
        "short": rng.integers(1, 90, 4000).tolist(),
        "mixed": rng.integers(1, 4097, 6000).tolist(),
        "large": [3000] * 500 + [4096] * 100 + [1096] * 200 + [5] * 3000,
    }[kind]
    df = cut(spark.createDataFrame([(i % 1500, 0, n) for i, n in enumerate(lengths)], "doc_id long, start long, length long"))
    rows = packing.pack(df).collect()
    assert sorted(r["length"] for r in rows) == sorted(lengths)
    waste = check_packing(rows, 4096)
    by_class = 3.5 * len(lengths) / sum(lengths)  # half a grain for each piece
    assert waste < by_class + {"one length": 0.03, "short": 0.02, "mixed": 0.03, "large": 0.147}[kind]  # large: 600 windows at least


@pytest.mark.parametrize("lengths", [[1] * 9000, [9] * 2000, [2100] * 400, [9] * 1000 + [3000] * 1000 + [*range(1, 4097, 4)]])
def test_full_packing_leaves_less_than_a_window(spark, lengths):
    ids = [np.arange(n, dtype="<u4") + 7 * i for i, n in enumerate(lengths)]
    rows = [(i % 50 or None, 0, len(x), bytearray(x.tobytes()), len(x)) for i, x in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, start long, length long, ids binary, doc_tokens long")
    got = packing.pack_full(df).collect()
    check_packing(got, 4096)
    assert len({r["sequence_id"] for r in got}) == -(-sum(lengths) // 4096)
    assert sum(r["length"] for r in got) == sum(lengths) and len(got) <= len(lengths) + sum(lengths) // 4096 + 1
    # Checksums of all possible parts of repeated documents are too many; each row's is that of a part of one of its documents.
    by_doc = {}
    for doc, _, _, x, _ in rows:
        by_doc.setdefault(doc, []).append(bytes(x))
    for r in got[::37]:
        a, b = 4 * r["start"], 4 * (r["start"] + r["length"])
        assert any(zlib.crc32(x[a:b]) == r["ids_crc32"] for x in by_doc[r["doc_id"]] if len(x) == 4 * r["doc_tokens"])


def test_whole_pieces_are_packed_by_their_exact_length(spark):
    df = cut(spark.createDataFrame([(i, 0, 9) for i in range(5000)], "doc_id long, start long, length long"))
    assert check_packing(packing.pack(df).collect(), 4096) < 0.01


def test_packing_without_pieces_and_with_wrong_ones(spark, no_docs, odd_docs):
    assert packing.pack(cut(packing.pieces(no_docs, PATHS[1]))).count() == 0
    assert check_packing(packing.pack(cut(packing.pieces(odd_docs, PATHS[1]))).collect(), 4096) < 2
    with pytest.raises(ValueError):
        packing.pack(cut(spark.createDataFrame([(1, 0, 5000)], "doc_id long, start long, length long")))


def test_least_squares_meets_its_conditions():
    rng = np.random.default_rng(2)
    histogram = rng.integers(0, 50, 64)
    combos = packing.combinations(64, histogram > 0)
    x = packing.solve(combos, histogram)
    matrix = np.zeros((64, len(combos)))
    for i, combo in enumerate(combos):
        for k, n in combo:
            matrix[k - 1, i] += n
    gradient = matrix.T @ (matrix @ x - histogram)
    assert (x >= 0).all() and gradient.min() > -1e-3 and abs(gradient @ x) < 1e-2

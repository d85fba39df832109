import hashlib
import random

import numpy as np
import pytest

from netquant.llm import fingerprints as fp
from netquant.llm import queries

SF = "/root/testdata/sf0.001"


def names(text, level):
    symbols = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    first = np.array([0])
    for _ in range(level):
        symbols, first = fp.parse(symbols, first)
    return symbols.tolist()


def test_equal_substrings_share_inner_names_at_any_offset():
    rng = random.Random(1)
    for _ in range(50):
        middle = "".join(rng.choice("abcdefgh  ") for _ in range(600))
        a = "".join(rng.choice("xyzab") for _ in range(rng.randint(0, 50))) + middle + "qq"
        b = "".join(rng.choice("xyzab") for _ in range(rng.randint(0, 50))) + middle + "ttt"
        for level, lost in ((1, 12), (2, 12), (3, 12)):
            inside = names(middle, level)
            shared = set(inside) & set(names(a, level)) & set(names(b, level))
            assert len(set(inside)) - len(shared) <= lost


def test_phrases_are_short_and_runs_do_not_matter():
    for text in ("a" * 5000, "ab" * 4000, "abcd" * 1000, "".join(map(chr, range(33, 9000)))):
        n = len(text)
        assert len(names(text, 1)) <= n // 2 + 2
        assert len(fp.sketches([text])[0]) >= 1
    assert fp.sketches(["a" * 500])[0].tolist() != fp.sketches(["a" * 501])[0].tolist()


def test_likeness_follows_the_shared_part():
    rng = random.Random(2)
    text = ["".join(rng.choice("abcdefghijkl ") for _ in range(6000)) for _ in range(2)]
    own, other = fp.sketches(text)
    assert fp.likeness(own, own) == 1 and fp.likeness(own, other) < 0.05
    for share in (0.25, 0.5, 0.9):
        cut = int(6000 * share)
        mix = fp.sketches([text[0][:cut] + text[1][cut:]])[0]
        assert fp.likeness(own, mix) == pytest.approx(share / (2 - share), abs=0.2)
    assert fp.likeness(fp.sketches([""])[0], fp.sketches([""])[0]) == 1 and fp.likeness(own, fp.sketches([""])[0]) == 0


def test_short_texts_with_an_equal_half_are_alike():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghijkl ") for _ in range(rng.randint(20, 40))) for _ in range(401)]
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:])]
    own, half = fp.sketches(texts), fp.sketches(edited)
    near = [fp.likeness(a, b) for a, b in zip(own, half)]
    other = [fp.likeness(a, b) for a, b in zip(own, own[1:])]
    assert np.mean([v == 0 for v in near]) < 0.03 and np.mean(near) > 0.14 and np.mean(other) < 0.02


def brute(rows):
    """Rows are (id, text) in falling order of ids."""
    out = []
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, e, b = (fp.sketches([t])[0] for t in (text, edited, after))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((doc, len(text), sha, fp.fingerprint(a), fp.fingerprint(e), fp.likeness(a, e), fp.likeness(a, b)))
    return out


def test_op10_against_one_loop(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute(sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True))
    for rows in (4000, 7):
        monkeypatch.setattr(fp, "RANGE_ROWS", rows)
        assert sorted(map(tuple, queries.op10(spark, SF).collect())) == sorted(want)


def test_edges(spark, odd_docs, no_docs, monkeypatch):
    assert fp.compare_edited(no_docs).count() == 0 and fp.fingerprints(no_docs).count() == 0
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert fp.compare_edited(one).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    monkeypatch.setattr(fp, "RANGE_ROWS", 2)
    rows = fp.compare_edited(odd_docs).collect()
    assert len(rows) == odd_docs.count() and sum(r["doc_id"] is None for r in rows) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    prints = {}
    for r in fp.fingerprints(odd_docs).collect():
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and prints[2] == {""}

import random
import re
from collections import Counter

import numpy as np
import pytest

from netquant.llm import neardup, queries

SF = "/root/testdata/sf0.001"


def weighted_set(text, idf):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    grams = [" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))]
    code = {}
    for g in set(grams):
        code[g] = int(neardup.shingles([g])[0][0])
    return {g: n * idf[code[g] % neardup.SKETCH] for g, n in Counter(grams).items()}


def jaccard(a, b):
    low = sum(min(w, b[g]) for g, w in a.items() if g in b)
    return low / (sum(a.values()) + sum(b.values()) - low)


def brute(rows, idf, similar=0.8):
    sets = [weighted_set(t, idf) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= similar:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {rows[i][0]: min(rows[k][0] for k in range(len(rows)) if root(k) == root(i)) for i in range(len(rows))}


def planted():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(40, 150))]
        texts.append(" ".join(base))
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(rng.choice([" ", "  ", "\n"]).join(words) + rng.choice(["", "!", "."]))
        texts.append(" ".join(base[:20] + passage))
    texts += ["one two", "One, two.", "alone", "same text here to see it"] + ["same text here to see it"] * 4
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_classes_against_all_pairs(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert got == brute(rows, neardup.rarity(docs))


def test_failed_members_meet_the_others(spark, monkeypatch):
    """With leaders that hardly link, links between other members must still be found; small tiles give the same."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in range(3):
            words[(i * 2 + k * 37) % 120] = f"x{i // 4}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, neardup.rarity(docs))
    for tile in (1500, 7):
        monkeypatch.setattr(neardup, "TILE", tile)
        assert {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()} == want


def test_equal_draws_estimate_similarity():
    rng = np.random.default_rng(5)
    code = np.sort(rng.integers(0, 2**63, 900).astype(np.uint64))
    agree = []
    for shared in (0.5, 0.8):
        n = int(600 * shared)
        a, b = code[:600], code[600 - n : 1200 - n]
        drawn = neardup.draws(np.concatenate([a, b]), np.concatenate([np.full(600, 1.2), np.full(len(b), 1.2)]), np.array([0, 600]))
        agree.append(((drawn[0] == drawn[1]).mean(), n / (600 + len(b) - n)))
    assert all(abs(got - true) < 0.25 for got, true in agree)
    weight = rng.uniform(0.5, 4, 900)
    many = [neardup.draws(np.tile(code + np.uint64(i), 2), np.concatenate([weight, weight * 0.5]), np.array([0, 900])) for i in range(30)]
    assert np.mean([(d[0] == d[1]).mean() for d in many]) == pytest.approx(0.5, abs=0.06)


def test_edges(spark, odd_docs, no_docs):
    rows = neardup.classes(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["class_id"] for r in rows if r["doc_id"] == 1} == {1} and {r["class_id"] for r in rows if r["doc_id"] in (2, 3)} == {2, 3}
    kept = neardup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [None, *range(1, 9)]))
    assert neardup.classes(no_docs).count() == 0 and neardup.drop_near_duplicates(no_docs).count() == 0


def test_equal_texts_of_signs_only_are_one_class(spark):
    rows = [(1, "-----"), (2, "😀 😀"), (3, "-----"), (4, "😀 😀"), (5, "----"), (6, ""), (7, ""), (8, None), (9, "one two three"), (10, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 9}
    assert sorted(r["doc_id"] for r in neardup.drop_near_duplicates(docs).collect()) == [1, 2, 5, 6, 7, 8, 9]


def test_op8_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], neardup.rarity(docs))
    assert {r["doc_id"]: r["class_id"] for r in queries.op8(spark, SF).collect()} == want

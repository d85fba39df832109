import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from netquant.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n long, word string, phrase string"


def brute(rows, least, first=2000):
    """The definition, phrase by phrase, with Python's whole numbers."""
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for i in range(len(words)):
                for size in range(1, 6):
                    if i + size <= len(words):
                        count[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in count.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in kept.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    part = p[i : i + size]
                    longer[part] = max(longer[part], a)
        scored = []
        for p, a in kept.items():
            if 100 * longer[p] >= 100 * a:
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_counting(spark, seed):
    rng = random.Random(seed)
    words = ["a", "B", "thé", "x-y", "of", "the", "\x00z", "KK", " ", "end"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "?!", "\x1c"]
    rows = []
    for _ in range(120):
        text = "".join(rng.choice(words[: rng.choice([3, 10])]) + rng.choice(gaps) for _ in range(rng.randrange(0, 60)))
        rows.append((text, rng.choice(["en", "de", None])))
    rows += [("a line that many texts share, and its end", "en")] * 30 + [(None, None), ("", "en"), (None, "fr"), (" \t.,", "fr")]
    df = spark.createDataFrame([(i, t, lang, 1, "w", "p") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    for least, first in ((5, 2000), (2, 7)):
        assert result(phrases.collocations(df, least=least, first=first)) == brute(rows, least, first)


def test_buckets_and_a_hot_line(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BUCKET", 20)
    rows = [("the same line in every text", "en")] * 300 + [(f"the same line w{i % 40} w{i % 7} again", "en") for i in range(400)]
    df = spark.createDataFrame([(i, t, lang, 1, "w", "p") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(7)
    assert result(phrases.collocations(df)) == brute(rows, 100)


def test_products_beyond_64_bits(spark):
    names = [bytes([i]) * 8 for i in (1, 2)]
    words = spark.createDataFrame([(bytearray(n), "en", w, 4_000_000_000_007) for n, w in zip(names, "ab")], "name binary, lang string, word string, n long")
    both = spark.createDataFrame([(bytearray(names[0] + names[1]), 3_999_999_999_999)], "phrase binary, a long")
    total = spark.createDataFrame([("en", 9_000_000_000_000_011)], "lang string, total long")
    row = phrases._ranked(phrases._scored(both, words, total), 10).first()
    assert row["score"] == 1000 * 3_999_999_999_999 * 9_000_000_000_000_011 // 4_000_000_000_007**2
    assert (row["phrase"], row["rank"], row["l"], row["r"]) == ("a b", 1, 4_000_000_000_007, 4_000_000_000_007)


def test_quicksort_counts_partitions():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(3000):
        size = rng.integers(2, 6)
        rows.append([*rng.integers(1, 6, size).tolist(), *[0] * (5 - size)])
    suffix, n = np.array(rows, np.uint64), rng.integers(1, 4, len(rows))
    want = Counter()
    for row, k in zip(rows, n.tolist()):
        words = [w for w in row if w]
        if len(words) == 2:
            want[tuple(words)] += k
        for size in range(3, len(words) + 1):
            want[tuple(words[:size])] += k
    got = {tuple(np.frombuffer(p, np.uint64).tolist()): a for p, a in phrases.quicksorted(suffix, n, 20)}
    assert got == {p: a for p, a in want.items() if a >= 20}


def test_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 200)
    rng = random.Random(5)
    text = "".join(rng.choice("ab") * rng.randrange(1, 9) + rng.choice([" ", "  ", ". ", "\t"]) for _ in range(900)) + "c" * 700 + " d e"
    parts = list(phrases.segments(text.encode()))
    assert len(parts) > 10

    def grams(data, own):
        found = Counter()
        for piece in re.finditer(rb"[^\n]+", data):
            words = list(re.finditer(rb"[^ ]+", piece[0]))
            for i, w in enumerate(words):
                if piece.start() + w.start() < own:
                    found.update(b" ".join(x[0] for x in words[i : i + k]) for k in range(1, 6) if i + k <= len(words))
        return found

    whole = text.encode().translate(phrases.PLAIN)
    assert sum((grams(*p) for p in parts), Counter()) == grams(whole, len(whole))


def test_no_rows(spark, no_docs):
    assert phrases.collocations(no_docs).collect() == []

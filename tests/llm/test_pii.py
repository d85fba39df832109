import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquant.llm import pii, queries

SF = "/root/testdata/sf0.001"
#: The base patterns as the contract gives them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def odd_texts(n=1500):
    rng = random.Random(6)
    bits = ["a", "b.c", "@", "@x.y", ".", "-", "_", "%", "1", "12", "255", "256.", "1.2.3.4", ".5", " ", "  ", "+1 (555) 010-2030", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "é", "漢😀", "\n", "(", ")", "+", "000", "0001.2.3.4", "5500005555555559", "123-45-6789"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    return [*texts, None, "", "a" * 20000, "1" * 20000, "1." * 9000, "+1" + "." * 20000, "a@" * 5000, "- 1" * 6000]


def test_base_spans_equal_the_plain_patterns(spark):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.find(docs, pii.Booster([], 0.0, 1.0, 0.0, {})).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()
    want = {i: ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t)) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["s"] for r in rows} == want


def test_op4_digests_and_secrets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op4(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        spans, row = base_spans(d["text"]), got[d["doc_id"]]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert row["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]
        assert set(filter(None, text.split(","))) <= set(row["spans"].split(","))
        for m in re.finditer(r'token = "([0-9a-f]{40})"', d["text"] or ""):
            assert f"secret:{m.start(1)}:{m.end(1)}" in row["spans"]


def test_boosted_trees_learn_and_columns_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (4000, len(pii.FEATURES))).astype(float)
    y = ((x[:, 1] > 2) ^ (x[:, 11] > 3)).astype(float)
    trees, start = pii.boost(x[:3000], y[:3000])
    margin = start + sum(pii.leaf_values(t, x) for t in trees)
    assert ((margin > 0) == (y > 0))[3000:].mean() > 0.97
    model = pii.Booster(trees, start, *pii.calibrate(margin[3000:], y[3000:]), {})
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"{f} double" for f in pii.FEATURES))
    p = [r[0] for r in rows.select(pii.probability(F.struct(*pii.FEATURES), model)).collect()]
    assert p == pytest.approx((1 / (1 + np.exp(-(model.slope * margin[:50] + model.shift)))).tolist())


def test_redaction_and_edges(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(1, "é a@b.co, +1 555 010 2030!", 26), (2, None, None), (3, "", 0)], "doc_id long, text string, n_chars long")
    none = pii.Booster([], 0.0, 1.0, 0.0, {})
    rows = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(docs, none).collect()}
    assert rows == {1: ("é [EMAIL], [PHONE]!", 19), 2: (None, None), 3: ("", 0)}
    model = pii.train(odd_docs)
    assert pii.redact(odd_docs, model).columns == odd_docs.columns and pii.redact(odd_docs, model).count() == odd_docs.count()
    assert pii.train(no_docs).trees == [] and pii.find(no_docs, none).count() == 0


def test_long_secrets_and_hidden_addresses_are_proposed_and_redacted(spark):
    token, local = "a1B2c3" * 100, "x.y1" * 25
    texts = [f'token = "{token}" end', f"write to {local} [at] example [dot] org now", f'key: {"9f" * 20000}.']
    spans = [("secret", 9, 609), ("hidden_email", 9, 9 + len(local) + len(" [at] example [dot] org")), ("secret", 5, 40005)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: [(s["span_kind"], s["span_start"], s["span_end"]) for s in r["candidates"]] for r in pii.candidates(docs).collect()}
    assert all(span in rows[i] for i, span in enumerate(spans))
    every = pii.Booster([], 9.0, 1.0, 0.0, dict.fromkeys(pii.KINDS, 0.5))
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs, every).collect()}
    assert out == {0: 'token = "[SECRET]" end', 1: "write to [HIDDEN_EMAIL] now", 2: "key: [SECRET]."}


def test_long_runs_stay_linear(spark):
    texts = ["a" * 300_000, "a1" * 150_000, "a-" * 150_000 + "é", "a.b" * 100_000 + " [at] ", "- a1" * 60_000, "a at " * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.monotonic()
    assert pii.candidates(docs).select(F.size("candidates").alias("n")).count() == len(texts)
    assert pii.candidates(docs).agg(F.sum(F.size("candidates"))).first()[0] >= 1
    assert time.monotonic() - began < 60


def test_addresses_of_very_many_labels_and_texts_of_very_many_addresses(spark):
    long, hidden = "a@b" + ".c" * 100_000, "x a [at] b" + ".c" * 100_000
    many = "mail a1@b.cd, " * 2_000
    docs = spark.createDataFrame([(1, long), (2, hidden), (3, many)], "doc_id long, text string")
    model = pii.Booster([], 0.0, 1.0, 9.0, {"hidden_email": 0.5})
    out = pii.find(docs, model).select("doc_id", "spans.kind", "spans.start", "spans.end").collect()
    found = {r["doc_id"]: list(zip(r["kind"], r["start"], r["end"])) for r in out}
    assert found[1] == [("email", 0, len(long))]
    assert found[2] == [("hidden_email", 2, len(hidden))]
    assert found[3] == [("email", 5 + 14 * i, 12 + 14 * i) for i in range(2_000)]
    texts = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert texts == {1: "[EMAIL]", 2: "x [HIDDEN_EMAIL]", 3: "mail [EMAIL], " * 2_000}


def test_no_threshold_without_evidence(spark):
    one = spark.createDataFrame([(1, "see build_config_version_2024_final here")], "doc_id long, text string")
    model = pii.train(one)
    assert model.trees == [] and model.thresholds == {}
    assert pii.redact(one, model).first()["text"] == one.first()["text"]
    assert pii.least_probability(np.array([]), np.array([])) == 2.0
    assert pii.least_probability(np.array([0.4, 0.6]), np.array([1.0, 0.0])) == 2.0
    assert pii.least_probability(np.array([0.4, 0.7]), np.array([0.0, 1.0])) == 0.5

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netquant.llm import features, langid, packing, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_op1_finds_toxic_documents_and_leaves_clean_ones(spark, labels):
    rows = {r["doc_id"]: r for r in queries.op1(spark, SF).collect()}
    assert len(rows) == 1000
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    flagged = [known[i] for i, r in rows.items() if i in known and r["flagged"]]
    assert sum(flagged) >= 0.75 * sum(known.values()) and sum(flagged) >= 0.9 * len(flagged)


def test_op1_on_held_out_documents_against_a_single_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    known = docs.join(labels, "doc_id").withColumn("held_out", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 1).cache()
    learned = known.filter("not held_out")

    def f1(levels):
        chain = toxicity.train(learned.select("doc_id", "text"), learned.select("doc_id", "toxic"), levels=levels)
        assert chain.categories[-1] == "toxic" and len(chain.categories) == len(levels) + 1
        hits, flagged, toxic = (
            toxicity.score(known.filter("held_out"), chain)
            .agg(F.count_if(F.col("flagged") & (F.col("toxic") == 1)), F.count_if("flagged"), F.count_if(F.col("toxic") == 1))
            .first()
        )
        return 2 * hits / (flagged + toxic)

    chained, single = f1((2, 4)), f1(())
    print("held-out F1: chain", chained, "single model", single)
    assert chained > 0.75 and chained >= single - 0.02


def test_chain_trains_on_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    first = (x[:, 0] + rng.normal(size=600) * 0.5 > 0).astype(float)
    second = first * (x[:, 1] > 0)
    weights, limit = toxicity.fit_chain(x, np.stack([first, second], 1), np.arange(600) % 5, 5)
    assert [len(w) for w in weights] == [6, 7] and 0 < limit < 1
    p = toxicity.predict(np.hstack([x, toxicity.predict(x, weights[0])[:, None]]), weights[1])
    assert ((p > 0.5) == second).mean() > 0.85


def test_op9_is_right_on_held_out_documents(spark, docs):
    rows = queries.op9(spark, SF).collect()
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]][0] for r in held]) > 0.98


def test_mixtures_are_inferred(spark, docs):
    model = langid.train(docs)
    texts = {r["lang"]: r["text"] for r in docs.filter("n_chars > 3000").collect()}
    mixed = texts["de"][:2000] + " " + texts["fr"][:1000]
    pred, score, sets, shares, fit = langid.infer(model, [mixed, texts["es"], "", "12 34 !", "zz"], 6.0, 3, 12)
    assert pred[:2] == ["de", "es"] and set(sets[0]) == {"de", "fr"} and sets[1] == ["es"]
    assert shares[0][0] == pytest.approx(2 / 3, abs=0.12) and pred[2:4] == ["und", "und"] and score[2] == 0
    empty = langid.Model([], np.zeros((16, 0), np.float32))
    assert langid.infer(empty, ["abc"], 6.0, 3, 12)[0] == ["und"]


def test_mixtures_of_any_number_of_languages_converge(spark, docs):
    model = langid.train(docs)
    texts = {r["lang"]: r["text"] for r in docs.filter("n_chars > 4000").collect()}
    assert len(texts) == len(model.languages) == 4
    equal = " ".join(t[:3500] for t in texts.values())
    pred, score, sets, shares, fit = langid.infer(model, [equal, "", texts["de"]], 6.0, None, 12)
    assert sorted(sets[0]) == sorted(texts) and shares[0] == pytest.approx([0.25] * 4, abs=0.08) and sum(shares[0]) == pytest.approx(1)
    assert score[0] == shares[0][0] and sets[2] == ["de"]
    row = langid.identify(spark.createDataFrame([(equal,)], "text string"), model).first()
    assert sorted(row["lang_set"]) == sorted(texts)
    # Six made-up languages with a letter set of their own and one that they share.
    rng = np.random.default_rng(5)
    names = [f"l{i}" for i in range(6)]
    letters = ["abcdxyz", "efghxyz", "ijklxyz", "mnopxyz", "qrstxyz", "uvwxyz"]
    word = lambda i: "".join(rng.choice(list(letters[i]), 5))
    written = {n: " ".join(word(i) for _ in range(3000)) for i, n in enumerate(names)}
    made = langid.train(spark.createDataFrame(list(written.items()), "lang string, text string"))
    six = " ".join(t[:1200] for t in written.values())
    assert sorted(langid.infer(made, [six], 6.0, None, 12)[2][0]) == names


def test_expectation_maximisation_reaches_the_greatest_likelihood():
    rng = np.random.default_rng(8)
    runs = np.array([40, 7, 1, 300])
    base = rng.random(runs.sum())
    likely = np.stack([base, base * rng.uniform(0.9, 1.1, len(base)), rng.random(len(base))])  # two that hardly differ
    count = rng.integers(1, 9, len(base)).astype(float)
    one, value = langid.fit(likely, count, runs, np.full((3, 4), 1 / 3), 12)
    share = np.full((3, 4), 1 / 3)
    first, n = np.cumsum(runs) - runs, np.add.reduceat(count, np.cumsum(runs) - runs)
    for _ in range(50_000):
        part = likely * np.repeat(share, runs, axis=1)
        share = np.add.reduceat(part * (count / part.sum(0)), first, axis=1) / n
    top = np.add.reduceat(count * np.log((likely * np.repeat(share, runs, axis=1)).sum(0)), first)
    assert (top - value <= langid.TOLERANCE + 1e-9).all() and one.sum(0) == pytest.approx(1)


def test_texts_of_one_and_two_letters_have_a_language(spark, docs):
    model = langid.train(docs)
    short = ["A.", "I", "漢", "ab", " é", "1a", "a", "(x)", "b c", "\n\nZ\n"]
    blank = ["", " ", ".", "12", "😀"]
    for texts in (short + blank, *([t] for t in short + blank)):
        got = dict(zip(texts, zip(*langid.infer(model, texts, 6.0, None, 12))))
        for text, (pred, score, languages, shares, fit) in got.items():
            assert (pred == "und") == (text in blank) and (score > 0) == (text in short) and len(languages) == len(shares)
    grams = lambda t: sorted(features.letter_ngrams([t], 1 << 15)[0].tolist())
    assert grams("A.") == grams(" a ") == grams("-A") and len(grams("a")) == 1 and len(grams("abc d")) == 5
    both = features.letter_ngrams(["a", "", "b c"], 1 << 15)
    assert both[1].tolist() == [0, 2, 2, 2] and sorted(both[0].tolist()) == sorted(grams("a") + grams("b c"))


def test_weights_against_counting(spark, docs, labels):
    ratios, share = quality.log_ratios(docs, labels, buckets=1 << 12)
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    raw, target = np.ones(1 << 12), np.zeros(1 << 12)
    rows = docs.collect()
    for r in rows:
        bucket, _ = quality.ngram_buckets([r["text"] or ""], 1 << 12)
        raw += np.bincount(bucket, minlength=1 << 12)
        target += np.bincount(bucket, minlength=1 << 12) if r["doc_id"] in good else 0
    want = np.log((target + 20) / (raw / raw.sum() * target.sum() + 20))
    assert ratios == pytest.approx(want) and share == pytest.approx(len(good) / labels.count())
    got = {r["doc_id"]: r["log_weight"] for r in quality.weigh(docs, ratios).select("doc_id", "log_weight").collect()}
    for r in rows[:40]:
        assert got[r["doc_id"]] == pytest.approx(ratios[quality.ngram_buckets([r["text"]], 1 << 12)[0]].sum())


def test_op6_draws_top_k_and_keeps_clean_documents(spark, labels):
    rows = queries.op6(spark, SF).collect()
    kept = [r["draw"] for r in rows if r["selected"]]
    assert len(rows) == 1000 and min(kept) > max(r["draw"] for r in rows if not r["selected"])
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    clean = [r["selected"] for r in rows if known.get(r["doc_id"]) == 1]
    junk = [r["selected"] for r in rows if known.get(r["doc_id"]) == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.1


def test_gumbel_top_k_is_exact_for_any_k(spark):
    draws = spark.range(500).select((F.pmod(F.xxhash64("id"), F.lit(97)) / 7.0).alias("draw"))
    values = sorted((r["draw"] for r in draws.collect()), reverse=True)
    for k in (1, 10, 499, 500):
        assert quality.threshold(draws, k) == pytest.approx(values[k - 1])
    assert quality.threshold(draws, 0) is None and quality.threshold(draws, 501) is None


def test_edges(spark, odd_docs, no_docs, labels):
    n = odd_docs.count()
    chain = toxicity.train(odd_docs, labels)
    assert toxicity.score(odd_docs, chain).count() == n and toxicity.score(no_docs, chain).count() == 0
    assert quality.resample(odd_docs, labels).count() == n and quality.resample(no_docs, labels).count() == 0
    assert langid.predictions(odd_docs).count() == n and langid.predictions(no_docs).count() == 0
    nothing = labels.limit(0)
    assert not toxicity.score(odd_docs, toxicity.train(odd_docs, nothing)).filter("flagged").count()
    assert quality.resample(odd_docs, nothing).filter("selected").count() == n
    assert math.isfinite(quality.log_ratios(no_docs, nothing)[1])


def test_pipeline_runs_and_keeps_columns(spark, docs, odd_docs, no_docs):
    for start in (docs, odd_docs, no_docs):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.cut(stage(spark, at, SF), name)
            assert name == "packing" or out.columns == start.columns
            assert name == "packing" or out.count() <= at.count()
            at = out
    whole = corpus_pipeline.run(spark, SF)
    assert whole.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert packing.pack(corpus_pipeline.cut(packing.pieces(docs, queries.WORD_BPE))).count() >= docs.count()

"""Distributions, corrections, running ranks, integration and channel fits against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netquant.functions.distributions import normal_cdf, student_p_values, two_sided_normal_p
from netquant.operators import channels, correction, groups, integrate, ranking, sites

INF, NAN = float("inf"), float("nan")


def test_normal_tails(spark):
    zs = [-8.0, -3.1, -0.4, 0.0, 0.2, 0.7, 1.96, 4.5, 5.9, 12.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_cdf(F.col("z")).alias("c"), two_sided_normal_p(F.col("z")).alias("p"))
    for row in got.collect():
        assert row.c == pytest.approx(0.5 * math.erfc(-row.z / math.sqrt(2)), rel=1e-12)
        assert row.p == pytest.approx(math.erfc(abs(row.z) / math.sqrt(2)), rel=1e-12)


def test_student_table_values():
    # Published two-sided 5 % and 1 % points.
    t = np.array([12.706, 2.228, 1.984, 63.657, 3.169])
    got = student_p_values(t, np.array([1, 10, 100, 1, 10]))
    assert np.allclose(got, [0.05, 0.05, 0.05, 0.01, 0.01], atol=2e-5)
    assert np.isnan(student_p_values(np.array([NAN]), np.array([3.0])))[0]


@pytest.fixture
def many_slices(spark):
    """Keep every range partition as a slice, as large data would."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def plain_by(ps, method):
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    m = len(ps)
    c = sum(1 / k for k in range(1, m + 1)) if method == "BY" else 1.0
    q, low = [0.0] * m, 1.0
    for place in range(m, 0, -1):
        i = order[place - 1]
        low = min(low, c * m * ps[i] / place)
        q[i] = low
    return q


@pytest.mark.parametrize("method", ["BY", "BH"])
def test_correction_matches_definition(spark, method, many_slices):
    rng = random.Random(4)
    ps = [round(rng.random() ** 3, 3) for _ in range(300)]
    rows = [(g, i, p, True) for g in "ab" for i, p in enumerate(ps)] + [("a", 900, 0.0, False), ("a", 901, NAN, True)]
    df = spark.createDataFrame(rows, "g string, i int, p double, use boolean")
    got = {(r.g, r.i): r.q for r in correction.p_adjust(df, ["g"], method, use="use").collect()}
    want = plain_by(ps, method)
    assert all(got[g, i] == pytest.approx(want[i]) for g in "ab" for i in range(300))
    assert got["a", 900] == 0.0 and math.isnan(got["a", 901])
    if method == "BY":
        assert all(got["a", i] >= p - 1e-12 for i, p in enumerate(ps))


def test_correction_of_one_group(spark):
    df = spark.createDataFrame([(0.01,), (0.02,), (0.5,)], "p double")
    got = sorted(r.q for r in correction.p_adjust(df, (), "BH").collect())
    assert got == pytest.approx([0.03, 0.03, 0.5])


def test_harmonic(spark):
    got = spark.createDataFrame([(m,) for m in (1, 5, 200, 201, 10000)], "m long").select("m", correction.harmonic(F.col("m")).alias("h"))
    for row in got.collect():
        assert row.h == pytest.approx(sum(1 / k for k in range(1, row.m + 1)), rel=1e-12)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_values_cross_slices(spark, by, many_slices):
    rows = [("a", i, (i * 7) % 11) for i in range(200)] if not by else [(g, i, (i * 7) % 11) for g in "aab" for i in range(100 if g == "b" else 0, 200)]
    df = spark.createDataFrame(sorted(set(rows)), "g string, o int, v int")
    slices = ranking.sliced(df, by, "o")
    assert slices.select(ranking.SLICE).distinct().count() > 2
    got = slices
    for kind in ("sum", "max", "min"):
        got = ranking.running(got, by, "o", F.col("v"), kind, f"r_{kind}")
    data = sorted(set(rows))
    for row in got.collect():
        mine = [(o, v) for g, o, v in data if not by or g == row.g]
        assert row.r_sum == sum(v for o, v in mine if o <= row.o)
        assert row.r_max == max(v for o, v in mine if o <= row.o)
        assert row.r_min == min(v for o, v in mine if o >= row.o)


def test_grouped_median(spark, many_slices):
    rng = random.Random(2)
    rows = [(g, round(rng.random(), 2)) for g, n in (("a", 51), ("b", 40), ("c", 1)) for _ in range(n)]
    got = {r.g: r.m for r in ranking.grouped_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "m").collect()}
    for g in "abc":
        assert got[g] == pytest.approx(float(np.median([v for k, v in rows if k == g])))


def test_infinity_rule(spark):
    rows = [(INF, INF), (INF, -INF), (INF, 0.5), (INF, 3.5), (-INF, 0.5), (3.5, -INF), (1.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = [r.p for r in df.select(sites.infinity_rule(F.col("a"), F.col("b"), F.lit(1.0), F.lit(1.0), 2.0).alias("p")).collect()]
    assert got == [1.0, 0.0, 0.0, 1.0, 1.0, 0.0, None]


def test_align_sites_fills_missing(spark):
    df = spark.createDataFrame([("x", "s1", 1.0, 0.5, 3), ("y", "s2", 2.0, 0.1, 2)], "site_key string, sample string, log2_ratio double, sd double, n_meas long")
    got = {(r.site_key, r.sample): (r.log2_ratio, r.n_meas) for r in sites.align_sites(df).collect()}
    assert len(got) == 4 and got["x", "s1"] == (1.0, 3) and math.isnan(got["x", "s2"][0]) and got["x", "s2"][1] == 0


def test_permutations_keep_group_sizes_and_seed(spark):
    members = spark.createDataFrame([("c", f"s{i}", 1 if i < 3 else 2) for i in range(8)], "comparison_id string, sample string, side int")
    one = sorted(groups.permuted_membership(members, 5, seed=3).collect())
    assert one == sorted(groups.permuted_membership(members, 5, seed=3).collect())
    assert one != sorted(groups.permuted_membership(members, 5, seed=4).collect())
    for perm in range(1, 6):
        assert sum(r.side == 1 for r in one if r.perm_id == perm) == 3


def test_pooled_group_of_one_sample_counts_measurements(spark):
    rows = [("x", "a", v) for v in (1.0, 1.5, 2.0)] + [("x", s, v) for s in "bc" for v in (5.0, 5.5)]
    rows += [("y", "a", 3.0), ("y", "b", 3.0), ("y", "b", 3.0), ("z", "c", INF), ("z", "c", INF), ("z", "a", 0.1), ("z", "a", 0.2)]
    psm = spark.createDataFrame(rows, "site_key string, sample string, log2_ratio double")
    members = groups.group_against_rest(spark.createDataFrame([("g", "a")], "comparison_id string, sample string"), "abc")
    got = {r.site_key: r for r in groups.pooled_tests(psm, members).collect()}
    x = got["x"]
    assert (x.n_1, x.n_2, x.m_1, x.m_2) == (3, 4, 1.5, 5.25) and x.use_for_correction
    assert x.sd_1 == pytest.approx(0.5) and x.sd_2 == pytest.approx(np.std([5, 5.5, 5, 5.5], ddof=1)) and x.p < 0.001
    assert got["y"].sd_2 == 0.0 and not got["y"].use_for_correction and not got["z"].use_for_correction


@pytest.mark.parametrize("method", ["BY", "BH", "HOCHBERG", "HOLM"])
def test_counts_of_low_levels_equal_the_full_correction(spark, many_slices, method):
    rng = random.Random(3)
    rows = [(f"g{i % 4}", round(rng.random() ** (1 + 3 * (i % 4)), 4), rng.random() < 0.9) for i in range(800)]
    rows += [("none", NAN, True), ("none", None, False), ("rule", 0.0, False)]
    tests = spark.createDataFrame(rows, "g string, p double, use_for_correction boolean")
    full = groups.significant_sites(correction.p_adjust(tests, ["g"], method, use="use_for_correction"), ["g"])
    assert sorted(groups.significant_counts(tests, ["g"], 0.05, method).collect()) == sorted(full.collect())


def test_permutation_rounds_of_one_split_share_their_count(spark):
    rng = random.Random(5)
    rows = [(f"s{i}", s, rng.gauss(2.0 * (s < "c") * (i < 20), 0.5)) for i in range(40) for s in "abcd" for _ in range(3)]
    psm = spark.createDataFrame(rows, "site_key string, sample string, log2_ratio double")
    mine = spark.createDataFrame([("g", "a"), ("g", "b")], "comparison_id string, sample string")
    counts = {r.perm_id: r.n_significant for r in groups.random_vs_rest(psm, mine, rounds=30, samples="abcd").collect()}
    drawn = groups.permuted_membership(groups.group_against_rest(mine, "abcd"), 30)
    for perm in (1, 17, 30):
        part = drawn.filter(F.col("perm_id") == perm).drop("perm_id")
        tests = correction.p_adjust(groups.pooled_tests(psm, part), ["comparison_id"], use="use_for_correction")
        assert groups.significant_sites(tests).first().n_significant == counts[perm]
    assert len(counts) == 30 and max(counts.values()) > 0


def test_common_variance_is_the_root(spark):
    rng = random.Random(8)
    rows = [("s", f"g{g}", rng.gauss(0, 1.5), rng.uniform(0.5, 50)) for g in range(40) for _ in range(rng.randint(1, 5))]
    df = spark.createDataFrame(rows, "scale string, g string, x double, w double")
    variance = integrate.common_variance(df, ["g"], ["scale"]).first().variance
    excess = 0.0
    for g in {r[1] for r in rows}:
        part = [(x, 1 / (1 / w + variance)) for _, k, x, w in rows if k == g]
        if len(part) > 1:
            mean = sum(x * w for x, w in part) / sum(w for _, w in part)
            excess += sum(w * (x - mean) ** 2 for x, w in part) - (len(part) - 1)
    assert variance > 0 and abs(excess) < 1e-6


def test_one_value_per_group_passes_through(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "g string, x double, w double")
    got = {r.g: (r.x, r.w, r.variance) for r in integrate.integrate(df, ["g"]).collect()}
    assert got == {"a": (1.0, 2.0, 0.0), "b": (3.0, 4.0, 0.0)}


def test_outlier_is_dropped(spark):
    rng = random.Random(1)
    rows = [(f"g{g}", rng.gauss(0, 0.1), 100.0) for g in range(30) for _ in range(6)] + [("g0", 25.0, 100.0)]
    kept = integrate.drop_outliers(spark.createDataFrame(rows, "g string, x double, w double").withColumn("one", F.lit(1)), ["g"], ["one"], 0.01)
    assert kept.filter("x > 20").count() == 0


@pytest.mark.parametrize("fdr", [0.01, 0.2])
def test_dropped_outliers_against_whole_rounds(spark, fdr):
    """The settled groups and rescored ones give what scoring all rows in each round gives."""
    rng = random.Random(5)
    rows = [("s", f"g{g}", rng.gauss(0, 0.1), rng.choice((50.0, 100.0))) for g in range(400) for _ in range(1 + g % 8)]
    rows += [("s", f"g{g}", x, 100.0) for g in (4, 5, 6, 7, 12) for x in (8.0, 5.0, 3.0, 1.5)]  # the smaller ones show once the larger ones are gone
    rows += [("t", f"h{g}", rng.gauss(0, 0.1), 100.0) for g in range(40) for _ in range(3)]
    rows += [("t", "h0", 8.0, 100.0), ("t", "h0", 8.0, 100.0), ("t", "odd", NAN, 1.0), ("u", "one", 3.0, 1.0), ("t", "h1", INF, 1.0), ("t", "h2", 0.0, 0.0)]
    data = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, one string, g string, x double, w double")
    variance = {r.one: r.variance for r in integrate.common_variance(data, ["g"], ["one"]).collect()}
    kept = [r for r in enumerate(rows) if math.isfinite(r[1][2]) and r[1][3] > 0]
    rounds = 0
    while True:
        members, z = {}, {}
        for i, (s, g, x, w) in kept:
            members.setdefault((s, g), []).append((i, x, 1 / (1 / w + variance[s])))
        for (s, _), group in members.items():
            mean = sum(x * w for _, x, w in group) / sum(w for _, _, w in group)
            if len(group) > 1:
                z |= {i: (s, math.erfc(abs(x - mean) * math.sqrt(w * len(group) / (len(group) - 1)) / math.sqrt(2))) for i, x, w in group}
        of = {s: sorted(p for t, p in z.values() if t == s) for s in "stu"}
        bad = {i for i, (s, p) in z.items() if len(of[s]) * p / sum(q <= p * (1 + 1e-12) for q in of[s]) < fdr}
        if not bad:
            break
        kept, rounds = [r for r in kept if r[0] not in bad], rounds + 1
    assert rounds > (1 if fdr < 0.1 else 0) and len(kept) < len(rows) - 3
    got = integrate.drop_outliers(data, ["g"], ["one"], fdr)
    assert got.columns == ["one", "g", "i", "x", "w"] and sorted(r.i for r in got.collect()) == [i for i, _ in kept]
    only = data.filter("one = 's'").drop("one")
    assert sorted(r.i for r in integrate.drop_outliers(only, ["g"], [], fdr).collect()) == [i for i, row in kept if row[0] == "s"]
    assert integrate.drop_outliers(data.limit(0), ["g"], ["one"], fdr).count() == 0


def test_gaussian_fit_recovers_parameters():
    mid = np.linspace(-3, 5, 40)
    count = 120 * np.exp(-0.5 * ((mid - 0.7) / 0.9) ** 2)
    height, mu, sigma = channels.fit_curve(mid, count)
    assert (height, mu, sigma) == pytest.approx((120, 0.7, 0.9), rel=1e-6)


def test_gaussian_pvalues(spark):
    rng = random.Random(6)
    rows = [(f"p{i}", "a", "b", rng.gauss(1.0, 0.5)) for i in range(400)] + [("x", "a", "b", INF), ("y", "a", "b", NAN), ("z", "a", "b", 6.0)]
    df = spark.createDataFrame(rows, "psm_id string, channel_i string, channel_j string, log2_ratio double")
    got = {r.psm_id: r for r in channels.gaussian_pvalues(df).collect()}
    assert got["x"].q == 0.0 and math.isnan(got["y"].q) and got["z"].q < 0.05
    assert sum(r.q < 0.05 for r in got.values() if r.psm_id.startswith("p")) <= 2


def test_pair_index_round_trip(spark):
    n = 10
    order = [(i, j) for i in range(n) for j in range(i + 1, n)]
    df = spark.createDataFrame(order, "i int, j int").select("i", "j", channels.pair_index(F.col("i"), F.col("j"), F.lit(n)).alias("k"))
    assert all(order[r.k] == (r.i, r.j) for r in df.collect())
    assert df.select(channels.n_samples_of_pairs(45).alias("n")).first().n == 10


@pytest.mark.parametrize("most", [1000, 3, 1])
def test_means_come_from_the_written_groups(spark, monkeypatch, most):
    """Groups of one value, lists and long groups, null ones included, give the means of all rows; no group is exchanged again."""
    monkeypatch.setattr(integrate, "LISTED", most)
    rng = random.Random(2)
    rows = [("st"[g % 2], None if g == 8 else f"g{g}", rng.gauss(0, 1), rng.uniform(0.5, 9)) for g in range(12) for _ in range(1 + g % 5)]
    rows += [("u", "one", 3.0, 1.0), ("v", "odd", NAN, 1.0), (None, "g0", 1.0, 1.0), (None, "g0", 2.0, 1.0)]
    data = spark.createDataFrame(rows, "scale string, g string, x double, w double")
    variance = integrate.common_variance(data, ["g"], ["scale"])
    found = integrate.integrate(data, ["g"], ["scale"])
    want = {(r.scale, r.g): (r.x, r.w, r.variance, r.n) for r in integrate.integrate(data, ["g"], ["scale"], variance).collect()}
    got = {(r.scale, r.g): (r.x, r.w, r.variance, r.n) for r in found.collect()}
    assert got.keys() == want.keys() and all(a == pytest.approx(b) for k in got for a, b in zip(got[k], want[k]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert (", g#" in "".join(line for line in plan.splitlines() if "Aggregate" in line)) == (most < 5)

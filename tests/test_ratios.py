"""Truth tables of the ratio rules."""

import math

import pytest
from pyspark.sql import functions as F

from netquant.functions import ratios
from netquant.operators import aggregates

INF, NAN = float("inf"), float("nan")
BIG = ratios.OLD_INFINITY

# values, mean, count, spread (majority rule on)
CASES = [
    ([INF, INF], INF, 2, INF),
    ([-INF, -INF, -INF], -INF, 3, -INF),
    ([BIG, BIG], BIG, 2, BIG),
    ([-BIG], -BIG, 1, -BIG),
    ([NAN, NAN], NAN, 2, NAN),
    ([INF, INF, 1.0], INF, 2, INF),
    ([-INF, -INF, 1.0], -INF, 2, -INF),
    ([INF, INF, INF, -INF, 1.0], INF, 3, INF),
    ([INF, INF, -INF, 1.0, 2.0], 1.5, 2, math.sqrt(0.5)),
    ([INF, INF, -INF, -1.0, -2.0], NAN, 4, NAN),
    ([-INF, -INF, -INF, INF, 1.0], -INF, 3, NAN),
    ([-INF, -INF, INF, -1.0, -2.0], -1.5, 2, math.sqrt(0.5)),
    ([-INF, -INF, INF, 1.0, 2.0], NAN, 4, NAN),
    ([INF, INF, -INF, -INF, 1.0, 2.0, 3.0], 2.0, 3, 1.0),
    ([INF, INF, -INF, -INF, 5.0, 6.0], INF, 4, NAN),
    ([INF, INF, -INF, -INF, -5.0, -6.0], -INF, 4, NAN),
    ([INF, INF, -INF, -INF, 1.0, 2.0], NAN, 4, NAN),
    ([INF, INF, -INF, -INF, 1.0], NAN, 4, NAN),
    ([INF, INF, INF, 2.5, 1.5, 4.0], 8.0 / 3, 3, 1.2583057392117916),
    ([1.0, 3.0, NAN], 2.0, 2, math.sqrt(2.0)),
    ([INF, 1.0], 1.0, 1, NAN),
]


def same(a, b):
    if a is None or b is None:
        return a is b
    return (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) < 1e-12


def rows(spark, sets):
    data = [(i, float(v)) for i, values in enumerate(sets) for v in values]
    return spark.createDataFrame(data, "k int, x double")


def test_majority_truth_table(spark):
    got = rows(spark, [c[0] for c in CASES]).groupBy("k").agg(
        ratios.inf_mean("x").alias("m"), ratios.inf_count("x").alias("n"), ratios.inf_stddev("x").alias("s")
    ).orderBy("k").collect()
    for row, (values, mean, count, spread) in zip(got, CASES):
        assert same(row.m, mean) and row.n == count and same(row.s, spread), (values, row)


def test_merged_counts_give_the_same_mean(spark):
    data = rows(spark, [c[0] for c in CASES]).withColumn("part", F.monotonically_increasing_id() % 3)
    parts = data.groupBy("k", "part").agg(*ratios.ratio_stats("x"))
    k = ratios.RatioCounts.merged()
    got = parts.groupBy("k").agg(ratios.inf_mean(k).alias("m"), ratios.inf_count(k).alias("n")).orderBy("k").collect()
    for row, (values, mean, count, _) in zip(got, CASES):
        assert same(row.m, mean) and row.n == count, (values, row)


@pytest.mark.parametrize("values, mean, count", [([INF, INF, 1.0], 1.0, 1), ([INF, -INF], NAN, 0), ([INF, INF], INF, 2), ([NAN, 2.0], 2.0, 1)])
def test_without_majority(spark, values, mean, count):
    row = rows(spark, [values]).agg(ratios.inf_mean("x", False).alias("m"), ratios.inf_count("x", False).alias("n")).first()
    assert same(row.m, mean) and row.n == count


def test_empty_group_is_null(spark):
    row = rows(spark, [[1.0]]).filter("x > 5").agg(ratios.inf_mean("x").alias("m"), ratios.inf_count("x").alias("n")).first()
    assert row.m is None and row.n == 0


def test_safe_log2_ratio_never_raises(spark):
    data = [(4.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (None, 1.0)]
    got = [r.r for r in spark.createDataFrame(data, "a double, b double").select(ratios.safe_log2_ratio("a", "b").alias("r")).collect()]
    assert all(same(g, w) for g, w in zip(got, [2.0, INF, -INF, NAN, -INF])), got


def test_swap_twice_is_identity(spark):
    df = rows(spark, [[1.5, INF, -INF, NAN]]).withColumn("y", ratios.swap_ratio(ratios.swap_ratio("x")))
    assert all(same(r.x, r.y) for r in df.collect())


def test_array_helpers(spark):
    data = [([1.0, INF],), ([INF, INF],), ([INF, -INF],), ([1.0, NAN],)]
    got = spark.createDataFrame(data, "v array<double>").select(
        ratios.has_finite_and_inf("v").alias("mixed"), ratios.all_inf("v").alias("inf"), ratios.same_infinity("v").alias("same")
    ).collect()
    assert [(r.mixed, r.inf, r.same) for r in got] == [(True, False, INF), (False, True, INF), (False, True, None), (False, False, None)]


def test_site_texts_stay_out_of_the_measurements(spark):
    """A site's text lists all its places, so a row for each of them must not carry it."""
    sites = spark.createDataFrame([("p1", 1, "A#K1-B#K2"), ("p2", 3, "A#K1-B#K2"), ("p3", 2, "C#K9")], "peptide_key string, position int, site_key string")
    rows = spark.createDataFrame([("p1", 1, 1.0), ("p2", 3, 3.0), ("p3", 2, 5.0), ("p4", 2, 9.0)], "peptide_key string, position int, log2_ratio double")
    found = aggregates.site_ratio(sites, rows)
    groups = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line and "count" in line]
    assert groups and not any("site_key" in line for line in groups)
    assert sorted((r.site_key, r.log2_ratio, r.n_meas) for r in found.collect()) == [("A#K1-B#K2", 2.0, 2), ("C#K9", 5.0, 1)]

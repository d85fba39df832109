"""Comparisons between groups of samples: two groups, permutations, a group against the rest."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquant.functions.ratios import RatioCounts, inf_count, inf_mean, inf_stddev, is_finite, nan
from netquant.lineage import cut
from netquant.operators.correction import harmonic, p_adjust
from netquant.operators.ranking import running, sliced, with_totals
from netquant.operators.sites import is_discovery, sample_names, test_columns, with_distribution

# Counts that add up over samples.
COUNTS = ("n", "pos", "neg", "missing", "finite", "old_pos", "old_neg")


def sample_stats(rows: DataFrame, key: str = "site_key") -> DataFrame:
    """One row per site with the ratio counts of each of its samples, sorted by sample.

    Values are counted per site and sample map-side; a site's list is as long as there are samples.
    """
    counted = rows.groupBy(key, "sample").agg(*RatioCounts("log2_ratio").columns(""))
    spread = F.when(F.col("finite") > 1, F.col("sd") * F.col("sd") * (F.col("finite") - 1)).otherwise(0.0)
    centre = F.when(F.col("finite") > 0, F.col("mean")).otherwise(0.0)
    entry = F.struct("sample", *COUNTS, centre.alias("mean"), spread.alias("m2"))
    return counted.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_samples"))


def _merge(a: Column, b: Column) -> Column:
    """Counts of two disjoint sets of values; equal means leave the spread exactly as it is."""
    total, step = a["finite"] + b["finite"], b["mean"] - a["mean"]
    share = F.coalesce(F.try_divide(b["finite"].cast("double"), total), F.lit(0.0))
    return F.struct(
        *[(a[c] + b[c]).alias(c) for c in COUNTS],
        (a["mean"] + step * share).alias("mean"),
        (a["m2"] + b["m2"] + step * step * a["finite"] * share).alias("m2"),
    )


def _counts_of(merged: str) -> RatioCounts:
    k = RatioCounts.__new__(RatioCounts)
    for name in COUNTS:
        setattr(k, name, F.col(f"{merged}.{name}"))
    k.mean = F.when(k.finite > 0, F.col(f"{merged}.mean")).otherwise(nan())
    k.sd = F.when(k.finite > 1, F.sqrt(F.col(f"{merged}.m2") / (k.finite - 1))).otherwise(nan())
    return k


def side_means(held: DataFrame, membership: DataFrame, keys: Sequence[str], key: str = "site_key") -> DataFrame:
    """Mean, count and spread of both sides of every comparison at every site that has one of its samples.

    The list of comparisons (samples by side) is a scalar; all its comparisons are worked out inside the
    site's row, so no row per site, sample and comparison is shuffled.
    """
    keys = list(keys)
    sides = [F.array_sort(F.collect_set(F.when(F.col("side") == i, F.col("sample")))).alias(f"_in_{i}") for i in (1, 2)]
    listed = membership.groupBy(*keys).agg(*sides).agg(F.collect_list(F.struct(*keys, "_in_1", "_in_2")))
    rows = held.withColumn("_c", F.explode(listed.scalar())).select(key, "_samples", "_c.*")
    seen = F.transform("_samples", lambda x: x["sample"])
    rows = rows.filter(F.arrays_overlap(seen, "_in_1") | F.arrays_overlap(seen, "_in_2"))
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    columns = []
    for i in (1, 2):
        side = F.col(f"_in_{i}")
        members = F.filter("_samples", lambda x: F.array_contains(side, x["sample"]))
        rows = rows.withColumn(f"_s{i}", F.aggregate(members, none, _merge))
        k = _counts_of(f"_s{i}")
        columns += [F.coalesce(inf_mean(k), nan()).alias(f"m_{i}"), inf_count(k).alias(f"n_{i}"), inf_stddev(k).alias(f"sd_{i}")]
    return rows.select(*keys, key, *columns)


def group_tests(
    sites: DataFrame, membership: DataFrame, keys: Sequence[str] = ("comparison_id",),
    equal_var: bool = True, n_sigmas: float = 2.0, key: str = "site_key",
) -> DataFrame:
    """Uncorrected tests of the site ratios of side 1 against side 2; an absent (NaN) site is no measurement."""
    measured = F.when(~F.isnan("log2_ratio"), F.col("log2_ratio")).alias("log2_ratio")
    held = sample_stats(sites.select(key, "sample", measured), key)
    rows = with_distribution(side_means(held, membership, keys, key), sites)
    return test_columns(rows, equal_var, n_sigmas).drop("dist_mean", "dist_sd")


def pooled_tests(
    psm: DataFrame, membership: DataFrame, keys: Sequence[str] = ("comparison_id",),
    equal_var: bool = True, n_sigmas: float = 2.0, key: str = "site_key",
) -> DataFrame:
    """Uncorrected tests of all measurements of side 1 pooled against those of side 2, so n counts measurements.

    The distribution of ratios that the infinity rule looks at is that of the two pooled columns of the comparison.
    """
    keys = list(keys)
    held = cut(sample_stats(psm.select(key, "sample", "log2_ratio"), key), "samples")
    means = side_means(held, membership, keys, key)
    values = means.select(*keys, F.explode(F.array("m_1", "m_2")).alias("_m"))
    finite = F.when(is_finite("_m"), F.col("_m"))
    spread = values.groupBy(*keys).agg(
        F.coalesce(F.avg(finite), nan()).alias("dist_mean"), F.coalesce(F.stddev_samp(finite), nan()).alias("dist_sd")
    )
    return test_columns(means.join(spread, keys), equal_var, n_sigmas).drop("dist_mean", "dist_sd")


def group_compare(
    sites: DataFrame,
    membership: DataFrame,
    keys: Sequence[str] = ("comparison_id",),
    method: str = "BY",
    equal_var: bool = True,
    n_sigmas: float = 2.0,
    key: str = "site_key",
) -> DataFrame:
    """Site means of group 1 against group 2 of each comparison, tested and corrected over its sites.

    ``membership`` is ``(keys, sample, side)`` with side 1 or 2. All comparisons run as one job.
    """
    tests = group_tests(sites, membership, keys, equal_var, n_sigmas, key)
    return p_adjust(tests, list(keys), method, use="use_for_correction")


def significant_counts(tests: DataFrame, keys: Sequence[str], threshold: float = 0.05, method: str = "BY") -> DataFrame:
    """Significant sites of uncorrected tests, those with a rule-made p included.

    Under a step-up rule (BY, BH, HOCHBERG) an adjusted p is never below its p, so of the tests with p >= threshold
    only the number is needed: those below it are ranked, and the last rank whose adjusted value passes is the count.
    """
    keys, method = list(keys), method.upper()
    if method not in ("BY", "BH", "HOCHBERG"):
        return significant_sites(p_adjust(tests, keys, method, use="use_for_correction"), keys, threshold)
    low = F.col("p").isNotNull() & ~F.isnan("p") & (F.col("p") < threshold)
    usable = F.col("use_for_correction") & F.col("p").isNotNull() & ~F.isnan("p")
    levels = tests.withColumn("_p", F.when(usable & low, F.col("p"))).groupBy(*keys, "_p").agg(
        F.count_if(usable).alias("_ties"), F.count_if(~usable & low).alias("_ruled")
    )
    levels = cut(levels, "levels")
    totals = levels.groupBy(*keys).agg(F.sum("_ties").alias("_m"), F.sum("_ruled").alias("_ruled"))
    below = levels.filter(F.col("_p").isNotNull()).drop("_ruled")
    ranked = with_totals(running(sliced(below, keys, "_p"), keys, "_p", F.col("_ties"), "sum", "_rank"), totals, keys)
    m, k = F.col("_m"), F.col("_rank")
    if method == "HOCHBERG":
        value = (m - k + 1) * F.col("_p")
    else:
        value = (harmonic(m) if method == "BY" else F.lit(1.0)) * m * F.col("_p") / k
    passed = ranked.filter(value < threshold).groupBy(*keys).agg(F.max("_rank").alias("_passed"))
    both = totals.join(passed, keys, "left")
    return both.select(*keys, (F.coalesce("_passed", F.lit(0)) + F.col("_ruled")).alias("n_significant"))


def significant_sites(tests: DataFrame, keys: Sequence[str] = ("comparison_id",), threshold: float = 0.05) -> DataFrame:
    """Number of significant sites of each comparison."""
    return tests.groupBy(*keys).agg(F.count_if(is_discovery("q", threshold)).alias("n_significant"))


def two_group_membership(groups: DataFrame, first: str, second: str, comparison_id: str) -> DataFrame:
    """Membership of one comparison from a long ``(comparison_id, sample)`` list."""
    side = F.when(F.col("comparison_id") == first, 1).when(F.col("comparison_id") == second, 2)
    rows = groups.select("sample", side.alias("side")).filter(F.col("side").isNotNull())
    return rows.select(F.lit(comparison_id).alias("comparison_id"), "sample", "side")


def group_against_rest(groups: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Membership with side 2 = every sample outside the group (the complement)."""
    ids = groups.select("comparison_id").distinct()
    every = ids.withColumn("sample", F.explode(F.array(*[F.lit(s) for s in samples])))
    rest = every.join(groups, ["comparison_id", "sample"], "left_anti")
    inside = groups.select("comparison_id", "sample").distinct().withColumn("side", F.lit(1))
    return inside.unionByName(rest.withColumn("side", F.lit(2)))


def permuted_membership(membership: DataFrame, rounds: int, seed: int = 1, first_round: int = 1) -> DataFrame:
    """Random groups of the sizes of each comparison: ``(comparison_id, perm_id, sample, side)``.

    The order of the samples in a round is that of a seeded hash, so a round is the same whatever
    the partitioning and after the loss of a task.
    """
    sizes = Window.partitionBy("comparison_id")
    rounds_column = F.explode(F.sequence(F.lit(first_round), F.lit(first_round + rounds - 1)))
    shuffled = Window.partitionBy("comparison_id", "perm_id").orderBy("_draw", "sample")
    return (
        membership.withColumn("_n1", F.count_if(F.col("side") == 1).over(sizes))
        .withColumn("perm_id", rounds_column)
        .withColumn("_draw", F.md5(F.concat_ws("|", F.lit(str(seed)), "perm_id", "sample")))
        .withColumn("_place", F.row_number().over(shuffled))
        .select("comparison_id", "perm_id", "sample", F.when(F.col("_place") <= F.col("_n1"), 1).otherwise(2).alias("side"))
    )


def permutation_counts(
    rows: DataFrame, membership: DataFrame, rounds: int = 999, seed: int = 1, threshold: float = 0.05,
    method: str = "BY", tests: Callable[..., DataFrame] = group_tests, **options,
) -> DataFrame:
    """Significant sites of every round: ``(comparison_id, perm_id, n_significant)``.

    ``tests`` is :func:`group_tests` over sites or :func:`pooled_tests` over measurements. Rounds that draw the
    same samples have the same result, so each drawn split is tested once and its count goes to all its rounds.
    """
    keys = ["comparison_id", "perm_id"]
    drawn = permuted_membership(membership, rounds, seed)
    first_side = F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.col("sample"))))
    splits = drawn.groupBy(*keys).agg(first_side.alias("_split"))
    first = splits.groupBy("comparison_id", "_split").agg(F.min("perm_id").alias("_first"))
    distinct = drawn.join(first.select("comparison_id", F.col("_first").alias("perm_id")), keys, "left_semi")
    counts = significant_counts(tests(rows, distinct, keys, **options), keys, threshold, method)
    of_split = first.join(counts.withColumnRenamed("perm_id", "_first"), ["comparison_id", "_first"])
    return splits.join(of_split, ["comparison_id", "_split"]).select(*keys, "n_significant")


def permutation_summary(counts: DataFrame) -> DataFrame:
    """Mean number of significant sites by chance of each comparison."""
    return counts.groupBy("comparison_id").agg(
        F.count("*").alias("n_rounds"), F.avg("n_significant").alias("mean_random_significant")
    )


def mutant_vs_rest(
    psm: DataFrame, groups: DataFrame, least_discoveries: int = 1, threshold: float = 0.05,
    finished: DataFrame | None = None, samples: Sequence[str] | None = None, method: str = "BY", **options,
) -> DataFrame:
    """Measurements of each group of samples against those of all others, pooled; significant sites kept.

    ``psm`` is ``(site_key, sample, log2_ratio)`` with one row per measurement. ``finished`` names comparisons
    to leave out, such as those of an earlier output.
    """
    wanted = groups if finished is None else groups.join(finished.select("comparison_id"), "comparison_id", "left_anti")
    tests = pooled_tests(psm, group_against_rest(wanted, samples or sample_names(psm)), **options)
    tests = p_adjust(tests, ["comparison_id"], method, use="use_for_correction")
    counts = significant_sites(tests, threshold=threshold).filter(F.col("n_significant") >= least_discoveries)
    return tests.filter(is_discovery("q", threshold)).join(counts, "comparison_id")


def random_vs_rest(
    psm: DataFrame, groups: DataFrame, rounds: int = 100, seed: int = 1, samples: Sequence[str] | None = None, **options
) -> DataFrame:
    """Significant sites of random groups of each group's size against the rest, pooled anew every round."""
    membership = group_against_rest(groups, samples or sample_names(psm))
    return permutation_counts(psm, membership, rounds, seed, tests=pooled_tests, **options)


def largest_first(groups: DataFrame) -> DataFrame:
    """Comparisons by number of samples, longest list first."""
    return groups.groupBy("comparison_id").agg(F.countDistinct("sample").alias("n_samples")).orderBy(
        F.col("n_samples").desc(), "comparison_id"
    )

"""Site comparison over samples: alignment, pairwise tests, infinity rule and discoveries.

Sites stay in long form ``(site_key, sample, log2_ratio, sd, n_meas, ...)``; wide tables are made
only on output. Per-site work is bounded by the number of samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquant.functions.distributions import two_sided_student_p
from netquant.functions.ratios import INF, is_finite, is_inf, nan
from netquant.operators.aggregates import ratio_distribution
from netquant.operators.correction import p_adjust

PAIR = ("sample_i", "sample_j")


def sample_names(sites: DataFrame) -> list[str]:
    """Sorted sample names; as many as input files."""
    return [row[0] for row in sites.select("sample").distinct().orderBy("sample").collect()]


def align_sites(sites: DataFrame, samples: Sequence[str] | None = None, key: str = "site_key") -> DataFrame:
    """Every site in every sample; absent ones have NaN ratio and spread and zero counts.

    One aggregate per site holds its samples in a map and is exploded over the sample list, in
    place of a product of sites and samples with a join back.
    """
    samples = list(samples) if samples is not None else sample_names(sites)
    counts = [c for c in sites.columns if c in ("n_meas", "n_psm", "n_pep")]
    held = F.map_from_entries(F.collect_list(F.struct("sample", F.struct("log2_ratio", "sd", *counts))))
    per_site = sites.groupBy(key).agg(held.alias("_held"))
    every = per_site.select(key, F.explode(F.array(*[F.lit(s) for s in samples])).alias("sample"), "_held")
    value = F.try_element_at(F.col("_held"), F.col("sample"))
    return every.select(
        key,
        "sample",
        F.coalesce(value["log2_ratio"], nan()).alias("log2_ratio"),
        F.coalesce(value["sd"], nan()).alias("sd"),
        *[F.coalesce(value[c], F.lit(0)).alias(c) for c in counts],
    )


def swap_samples(sites: DataFrame, swapped: DataFrame) -> DataFrame:
    """Change the sign of the log ratio in the samples flagged ``swap`` (label swap)."""
    flags = swapped.select("sample", "swap")
    return (
        sites.join(flags, "sample", "left")
        .withColumn(
            "log2_ratio",
            F.when(F.coalesce("swap", F.lit(False)), -F.col("log2_ratio")).otherwise(F.col("log2_ratio")),
        )
        .drop("swap")
    )


def t_statistic(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column, equal_var: bool) -> tuple[Column, Column]:
    """Student's t and its degrees of freedom from means, variances and counts; no spread gives +-Inf or NaN."""
    a, b = n1.cast("double"), n2.cast("double")
    if equal_var:
        df = a + b - 2
        pooled = F.try_divide((a - 1) * v1 + (b - 1) * v2, df)
        error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b)))
    else:
        e1, e2 = F.try_divide(v1, a), F.try_divide(v2, b)
        error = F.sqrt(e1 + e2)
        df = F.try_divide((e1 + e2) * (e1 + e2), F.try_divide(e1 * e1, a - 1) + F.try_divide(e2 * e2, b - 1))
    difference = m1 - m2
    t = (
        F.when(error > 0, F.try_divide(difference, error))
        .when(difference > 0, F.lit(INF))
        .when(difference < 0, F.lit(-INF))
        .otherwise(nan())
    )
    return t, df


def infinity_rule(m1: Column, m2: Column, mean: Column, sd: Column, n_sigmas: float) -> Column:
    """p where an infinity takes part: 1 or 0, null when both are finite.

    A finite ratio counts as different from +Inf when below mean + n sd, from -Inf when above it.
    """
    limit = mean + F.lit(float(n_sigmas)) * sd
    finite = F.when(is_finite(m1), m1).otherwise(m2)
    infinite = F.when(is_inf(m1), m1).otherwise(m2)
    different = F.when(infinite == F.lit(INF), finite < limit).otherwise(finite > limit)
    return (
        F.when(is_inf(m1) & is_inf(m2), F.when(m1 == m2, 1.0).otherwise(0.0))
        .when(is_inf(m1) | is_inf(m2), F.when(different, 0.0).otherwise(1.0))
    )


def test_columns(rows: DataFrame, equal_var: bool = True, n_sigmas: float = 2.0) -> DataFrame:
    """Add t, df, p and use_for_correction to rows holding (m, sd, n)_1, (m, sd, n)_2, dist_mean, dist_sd."""
    m1, m2, s1, s2 = F.col("m_1"), F.col("m_2"), F.col("sd_1"), F.col("sd_2")
    untestable = (F.col("n_1") < 2) | (F.col("n_2") < 2) | F.isnan(s1) | F.isnan(s2)
    rule = infinity_rule(m1, m2, F.col("dist_mean"), F.col("dist_sd"), n_sigmas)
    t, df = t_statistic(m1, s1 * s1, F.col("n_1"), m2, s2 * s2, F.col("n_2"), equal_var)
    testable = ~untestable & rule.isNull()
    staged = rows.withColumns(
        {
            "t": F.when(testable, t).otherwise(nan()),
            "df": F.when(testable, df).otherwise(nan()),
            "_rule": F.when(~untestable, rule),
            "use_for_correction": testable,
        }
    )
    return staged.withColumn("p", F.coalesce("_rule", two_sided_student_p(F.col("t"), F.col("df")))).drop("_rule")


def with_distribution(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Add the mean and spread of the whole ratio distribution as a scalar subquery."""
    both = ratio_distribution(sites).select(F.struct("dist_mean", "dist_sd")).scalar()
    return rows.withColumn("_d", both).withColumns(
        {"dist_mean": F.col("_d.dist_mean"), "dist_sd": F.col("_d.dist_sd")}
    ).drop("_d")


def pairwise_tests(
    sites: DataFrame, equal_var: bool = True, n_sigmas: float = 2.0, key: str = "site_key"
) -> DataFrame:
    """One row per site and sample pair i < j of aligned sites: t, df, p, use_for_correction."""
    entry = F.struct(
        F.col("sample"), F.col("log2_ratio").alias("m"), F.col("sd").alias("sd"), F.col("n_meas").alias("n")
    )
    per_site = sites.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_row"))
    # The samples of one site, so the pairs of a row are as many as the pairs of samples.
    pairs = F.flatten(
        F.transform(
            "_row",
            lambda a: F.transform(
                F.filter("_row", lambda b: b["sample"] > a["sample"]), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
    long = per_site.select(key, F.explode(pairs).alias("_pair")).select(
        key,
        F.col("_pair.a.sample").alias("sample_i"),
        F.col("_pair.b.sample").alias("sample_j"),
        *[F.col(f"_pair.{side}.{c}").alias(f"{c}_{i}") for i, side in ((1, "a"), (2, "b")) for c in ("m", "sd", "n")],
    )
    return test_columns(with_distribution(long, sites), equal_var, n_sigmas).drop("dist_mean", "dist_sd")


def adjusted_tests(tests: DataFrame, method: str = "BY") -> DataFrame:
    """Corrected p within each sample pair; rule-made and missing p are left out and stay as they are."""
    return p_adjust(tests, PAIR, method, use="use_for_correction")


def is_discovery(q: str | Column = "q", threshold: float = 0.05) -> Column:
    q = F.col(q) if isinstance(q, str) else q
    return F.coalesce(~F.isnan(q) & (q < threshold), F.lit(False))


def discoveries(tests: DataFrame, threshold: float = 0.05, key: str = "site_key") -> DataFrame:
    """Number of discoveries of each site."""
    return tests.groupBy(key).agg(F.count_if(is_discovery("q", threshold)).alias("n_disc"))


def pair_discoveries(tests: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Number of discoveries of each sample pair."""
    return tests.groupBy(*PAIR).agg(F.count_if(is_discovery("q", threshold)).alias("n_disc"))


def discovery_histogram(per_site: DataFrame) -> DataFrame:
    """Number of sites by number of discoveries."""
    return per_site.groupBy("n_disc").agg(F.count("*").alias("n_sites"))


def min_discoveries(per_site: DataFrame, least: int) -> DataFrame:
    return per_site.filter(F.col("n_disc") >= least)


def quantified_site_counts(sites: DataFrame, key: str = "site_key") -> DataFrame:
    """Sites, sites with any value and sites never quantified: one row."""
    seen = sites.groupBy(key).agg(F.bool_or(~F.isnan("log2_ratio")).alias("_seen"))
    return seen.agg(
        F.count("*").alias("n_sites"),
        F.count_if("_seen").alias("n_quantified"),
        F.count_if(~F.col("_seen")).alias("n_never_quantified"),
    )


def subset_sites(sites: DataFrame, subset: DataFrame) -> DataFrame:
    """Sites at a named protein, or at a named protein position where ``subset.position`` is not null.

    ``sites`` holds ``protein_acc`` and ``position``. Each form is an equi-join of its own.
    """
    whole = subset.filter(F.col("position").isNull()).select("protein_acc")
    exact = subset.filter(F.col("position").isNotNull()).select("protein_acc", "position")
    by_position = sites.join(exact, ["protein_acc", "position"], "left_semi")
    by_protein = sites.join(whole, ["protein_acc"], "left_semi")
    return by_position.join(whole, ["protein_acc"], "left_anti").unionByName(by_protein)


def site_union(tables: Sequence[DataFrame], key: str = "site_key") -> DataFrame:
    """Distinct site keys over all samples."""
    keys = tables[0].select(key)
    for table in tables[1:]:
        keys = keys.union(table.select(key))
    return keys.distinct()


def by_ratios(sites: DataFrame, samples: Sequence[str], key: str = "site_key") -> DataFrame:
    """Sites ordered by their ratios sample after sample, infinities and missing last."""
    wide = sites.groupBy(key).pivot("sample", list(samples)).agg(F.first("log2_ratio"))
    order = []
    for s in samples:
        c = F.col(f"`{s}`")
        order += [~F.coalesce(is_finite(c), F.lit(False)), c.asc()]
    return wide.orderBy(*order, key)


def by_discoveries(per_site: DataFrame, *tie_break: str) -> DataFrame:
    """Most discoveries first, then the given columns."""
    return per_site.orderBy(F.col("n_disc").desc(), *tie_break)

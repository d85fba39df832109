"""Ratio and count aggregates over peptides, nodes, sites and genes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquant.functions.ratios import (
    RatioCounts,
    finite_mean,
    finite_stddev,
    inf_count,
    inf_mean,
    inf_stddev,
    is_finite,
    nan,
    ratio_stats,
    safe_log2_ratio,
)


def ratio_by(rows: DataFrame, keys: Sequence[str], c: str = "log2_ratio", majority: bool = True) -> DataFrame:
    """Mean, count and spread of a ratio per group under the infinity rules."""
    k = RatioCounts.read("_")
    return rows.groupBy(*keys).agg(*RatioCounts(c).columns("_")).select(
        *keys,
        inf_mean(k, majority).alias("log2_ratio"),
        inf_count(k, majority).alias("n_meas"),
        inf_stddev(k, majority).alias("sd"),
    )


def peptide_ratio(psm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Consensus ratio of each peptide."""
    return ratio_by(psm, [*by, "peptide_key"])


def node_ratio(
    psm: DataFrame, members: DataFrame, by: Sequence[str] = (), replicate: str | None = None, majority: bool = True
) -> DataFrame:
    """Representative ratio of each peptide node from the PSMs of its members, optionally one replicate."""
    rows = psm if replicate is None else psm.filter(F.col("replicate") == replicate)
    return ratio_by(rows.join(members, [*by, "peptide_key"]), [*by, "peptide_node"], majority=majority)


def node_replicate_ratio(psm: DataFrame, members: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Representative ratio of each peptide node in each replicate."""
    return ratio_by(psm.join(members, [*by, "peptide_key"]), [*by, "peptide_node", "replicate"])


def node_stats(psm: DataFrame, members: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Additive ratio counts per peptide node, from which any set of nodes takes its mean."""
    per_peptide = psm.groupBy(*by, "peptide_key").agg(*ratio_stats("log2_ratio"))
    joined = per_peptide.join(members, [*by, "peptide_key"])
    columns = [F.sum(c).alias(c) for c in per_peptide.columns if c not in (*by, "peptide_key")]
    return joined.groupBy(*by, "peptide_node").agg(*columns)


def merged_ratio(rows: DataFrame, keys: Sequence[str], out: str = "log2_ratio") -> DataFrame:
    """Mean ratio of groups of additive counts (see :func:`node_stats`)."""
    k = RatioCounts.read("_")
    summed = rows.groupBy(*keys).agg(*RatioCounts.merged().columns("_"))
    return summed.select(*keys, inf_mean(k).alias(out), inf_count(k).alias(f"n_{out}"))


def site_ratio(site_peptides: DataFrame, psm_ratio: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ratio of each site from the measurements made at its position of the peptide.

    ``site_key`` lists all places of a site, as many as its measurements: those carry two 64-bit hashes of it, the text joins the result.
    """
    on, short = [*by, "peptide_key", "position"], ["_site_1", "_site_2"]
    sites = site_peptides.withColumns({c: F.xxhash64(F.lit(i + 1), "site_key") for i, c in enumerate(short)})
    ratios = ratio_by(psm_ratio.join(sites.select(*on, *short).distinct(), on), [*by, *short])
    names = sites.select(*by, *short, "site_key").distinct()
    return ratios.join(names, [*by, *short]).select(*by, "site_key", "log2_ratio", "n_meas", "sd")


def ri_ratio(psm: DataFrame, members: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Intensity ratio: mean of finite ratios per peptide node, then mean over the nodes of a group."""
    per_node = (
        psm.join(members, [*by, "peptide_key"])
        .groupBy(*by, "peptide_node")
        .agg(finite_mean("log2_ratio").alias("node_ratio"))
    )
    if list(keys) == ["peptide_node"]:
        return per_node.withColumnRenamed("node_ratio", "ri")
    groups = members.select(*by, "peptide_node", *keys).distinct()
    return per_node.join(groups, [*by, "peptide_node"]).groupBy(*by, *keys).agg(finite_mean("node_ratio").alias("ri"))


def rc_ratio(psm: DataFrame, members: DataFrame, by: Sequence[str] = (), per_replicate: bool = False) -> DataFrame:
    """Ion-count ratio of each node: log2 of ions in condition 1 over ions in condition 2."""
    keys = [*by, "peptide_node", *(["replicate"] if per_replicate else [])]
    counts = (
        psm.join(members, [*by, "peptide_key"])
        .groupBy(*keys)
        .agg(F.sum("ions_1").alias("ions_1"), F.sum("ions_2").alias("ions_2"))
    )
    return counts.withColumn("rc", safe_log2_ratio("ions_1", "ions_2"))


RATIO_COLUMNS = {"quantified": "log2_ratio", "isobaric_intensity": "ri", "isobaric_count": "rc"}


def ratio_column(kind: str) -> str:
    """The ratio column that an input kind is reported by."""
    return RATIO_COLUMNS[kind]


def individual_values(psm: DataFrame, members: DataFrame, by: Sequence[str] = (), level: str = "peptide") -> DataFrame:
    """One row per individual value of a node: each peptide's consensus ratio or each PSM's ratio."""
    if level == "psm":
        values = psm.select(*by, "peptide_key", "psm_id", "log2_ratio")
    else:
        values = psm.groupBy(*by, "peptide_key").agg(inf_mean("log2_ratio").alias("log2_ratio"))
    return values.join(members, [*by, "peptide_key"])


def node_measurements(psm: DataFrame, members: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per peptide node in one pass: PSMs, runs, replicates, raw files, ratio, its count and spread.

    ``psm`` has one row per psm_id. Runs and replicates are gathered as sets, which are as small as
    the list of input files; several distinct counts would multiply every row instead.
    """
    k = RatioCounts.read("_")
    key = [*by, "peptide_node"]
    gathered = psm.join(members, [*by, "peptide_key"]).groupBy(*key).agg(
        F.count("*").alias("n_psms"),
        F.collect_set("raw_file").alias("_files"),
        F.collect_set("replicate").alias("_replicates"),
        *RatioCounts("log2_ratio").columns("_"),
    )
    return gathered.select(
        *key,
        "n_psms",
        F.size("_files").alias("n_runs"),
        F.size("_replicates").alias("n_replicates"),
        F.concat_ws(",", F.array_sort("_files")).alias("raw_files"),
        inf_mean(k).alias("log2_ratio"),
        inf_count(k).alias("n_meas"),
        inf_stddev(k).alias("sd"),
    )


def node_counts(
    psm: DataFrame, members: DataFrame, links: DataFrame, protein_members: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Per peptide node: its measurements, peptides, connected nodes and individual proteins."""
    by = list(by)
    key = [*by, "peptide_node"]
    sizes = protein_members.groupBy(*by, "protein_node").agg(F.count("*").alias("_size"))
    around = links.join(sizes, [*by, "protein_node"]).groupBy(*key).agg(
        F.count("*").alias("n_connected"), F.sum("_size").alias("n_proteins")
    )
    peptides = members.groupBy(*key).agg(F.count("*").alias("n_peptides"))
    return node_measurements(psm, members, by).join(peptides, key).join(around, key)


def ratio_distribution(sites: DataFrame, c: str = "log2_ratio") -> DataFrame:
    """Mean and spread of the finite ratios of all samples: one row."""
    return sites.agg(finite_mean(c).alias("dist_mean"), finite_stddev(c).alias("dist_sd"))


def cluster_replicate_means(
    psm: DataFrame, cluster_peptides: DataFrame, genes: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Linear ratio of each cluster in each replicate and its inverse, long form, with the gene string.

    ``genes`` is (cluster_id, genes) of the allowed taxa: clusters without a gene do not appear, nor
    do replicates whose ratio is not a number. PSMs are counted per peptide before the join.
    """
    by = list(by)
    per_peptide = psm.groupBy(*by, "peptide_key", "replicate").agg(*ratio_stats("log2_ratio"))
    joined = per_peptide.join(cluster_peptides, [*by, "peptide_key"])
    ratios = merged_ratio(joined, [*by, "cluster_id", "replicate"]).filter(is_finite("log2_ratio"))
    named = genes.filter(F.col("genes").isNotNull() & (F.col("genes") != ""))
    return ratios.join(named, [*by, "cluster_id"]).select(
        *by,
        "cluster_id",
        "genes",
        "replicate",
        F.pow(F.lit(2.0), F.col("log2_ratio")).alias("mean_ratio"),
        F.pow(F.lit(2.0), -F.col("log2_ratio")).alias("inverse_ratio"),
    )


def pivot_replicates(means: DataFrame, replicates: Sequence[str], value: str, keys: Sequence[str]) -> DataFrame:
    """One column per replicate; the list is given, so no pass is spent on finding it."""
    return means.groupBy(*keys).pivot("replicate", list(replicates)).agg(F.first(value))


def significant(fdr: Column | str, log2_ratio: Column | str, threshold: float) -> Column:
    """An infinite ratio, or an FDR within the threshold."""
    fdr = F.col(fdr) if isinstance(fdr, str) else fdr
    log2_ratio = F.col(log2_ratio) if isinstance(log2_ratio, str) else log2_ratio
    in_fdr = F.coalesce(~F.isnan(fdr) & (fdr <= threshold), F.lit(False))
    return in_fdr | F.coalesce(F.abs(log2_ratio) == F.lit(float("inf")), F.lit(False))


def summary(nodes: DataFrame, by: Sequence[str] = (), fdr_threshold: float = 0.05) -> DataFrame:
    """Metrics over the final node table, one row per (by, metric).

    ``nodes`` holds cluster_id, peptide_node, log2_ratio, weight, fdr and taxonomy.
    """
    by = list(by)
    finite = is_finite("log2_ratio")
    sig = significant("fdr", "log2_ratio", fdr_threshold)
    metrics = nodes.groupBy(*by).agg(
        F.count("*").alias("peptide_nodes"),
        F.countDistinct("cluster_id").alias("clusters"),
        F.count_if(F.col("log2_ratio") == F.lit(float("inf"))).alias("positive_infinities"),
        F.count_if(F.col("log2_ratio") == F.lit(float("-inf"))).alias("negative_infinities"),
        F.count_if(F.isnan("log2_ratio")).alias("missing_ratios"),
        F.count_if(finite).alias("finite_ratios"),
        F.count_if(sig).alias("significant_nodes"),
        F.countDistinct(F.when(sig, F.col("cluster_id"))).alias("significant_clusters"),
        F.coalesce(F.avg(F.when(finite, F.col("log2_ratio"))), nan()).alias("mean_finite_ratio"),
        F.coalesce(F.stddev_samp(F.when(finite, F.col("log2_ratio"))), F.lit(0.0)).alias("sd_finite_ratio"),
        F.coalesce(F.avg(F.when(F.col("weight") > 0, F.lit(1.0) / F.col("weight"))), nan()).alias("mean_variance"),
    )
    names = [c for c in metrics.columns if c not in by]
    pairs = ", ".join(f"'{name}', cast({name} as double)" for name in names)
    return metrics.select(*by, F.expr(f"stack({len(names)}, {pairs}) as (metric, value)"))


def infinities_by_species(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of infinite and missing ratios of nodes per species string."""
    return nodes.groupBy(*by, "taxonomy").agg(
        F.count("*").alias("n_nodes"),
        F.count_if(F.col("log2_ratio") == F.lit(float("inf"))).alias("n_pos_inf"),
        F.count_if(F.col("log2_ratio") == F.lit(float("-inf"))).alias("n_neg_inf"),
        F.count_if(F.isnan("log2_ratio")).alias("n_missing"),
    )

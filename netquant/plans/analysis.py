"""The three analyses as compositions of operators: network run, site comparison, dataset comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquant.lineage import cut
from netquant.operators import (
    aggregates, align, annotate, channels, components, datasets, filters, groups, integrate, network, nodes, pairs, reports, sites,
)
from netquant.sources import readers


def analyse_network(
    psm: DataFrame,
    psm_protein: DataFrame,
    protein: DataFrame,
    by: Sequence[str] = (),
    *,
    ignore_modified: bool = False,
    decoys: str | None = None,
    skip_singletons: bool = False,
    collapse: bool = True,
    node_filters: Mapping[str, int] | None = None,
    similarity: bool = False,
    fold: float = 2.0,
    outlier_test: bool = False,
    outlier_fdr: float | None = None,
    fdr_threshold: float = 0.05,
) -> dict[str, DataFrame]:
    """From PSMs to every output table of a run, or of a batch of runs keyed by ``by``.

    ``psm`` has one row per psm_id: peptide_key, experiment, replicate, raw_file, log2_ratio, weight,
    ions, singleton and, to ignore modified peptides, has_ptm. ``psm_protein`` is (psm_id, protein_acc),
    ``protein`` (protein_acc, gene, taxonomy, description). Shared intermediate tables are written
    once; the returned tables are plans on them. With ``outlier_test`` the modified Z decides pairs with
    enough values in place of the middle-half rule.
    """
    by = list(by)
    log: list[tuple[DataFrame, str, str]] = []
    rows = psm
    if skip_singletons:
        rows = filters.drop_singletons(rows)
    if ignore_modified:
        log.append((rows.filter("has_ptm"), filters.CONTAINING_PTM, "modified"))
        rows = filters.drop_modified(rows)
    psm_protein = filters.drop_decoys(psm_protein, decoys)
    edges = nodes.peptide_protein_edges(rows, psm_protein, by)
    orphans = rows.join(edges.select(*by, "peptide_key"), [*by, "peptide_key"], "left_anti")
    log.append((orphans, filters.PEPTIDE_WITH_NO_PROTEIN, ""))
    rows = filters.drop_orphans(rows, edges, by)
    if node_filters:
        before = rows
        rows, edges = filters.filter_to_fixpoint(rows, edges, by, **node_filters)
        lost = before.join(rows.select(*by, "peptide_key"), [*by, "peptide_key"], "left_anti")
        log.append((lost, filters.FILTERED_NODE, ", ".join(f"{k}={v}" for k, v in node_filters.items())))
    else:
        edges = cut(edges, "edges")

    similar = align.align_peptides(edges) if similarity else None
    similar = cut(similar, "alignments") if similar is not None else None
    cluster_of = cut(components.clusters(edges, by, similar), "clusters")
    peptide_nodes = cut(nodes.collapse_peptides(edges, by, collapse), "peptide_nodes")
    protein_nodes = cut(nodes.collapse_proteins(edges, by, collapse), "protein_nodes")
    links = cut(nodes.node_edges(edges, peptide_nodes, protein_nodes, by), "links")

    table = cut(reports.node_table(rows, peptide_nodes, links, protein_nodes, protein, by), "node_table")
    integrated = cut(integrate.integrate_chain(rows, peptide_nodes, by, outlier_fdr), "integrated")
    in_cluster = components.cluster_peptides(edges, cluster_of, by)
    final = cut(reports.final_table(integrated, table, in_cluster, by), "final")

    stats = aggregates.node_stats(rows, peptide_nodes, by)
    ratios = cut(pairs.pair_ratios(links, stats, by), "pair_ratios")
    if outlier_test:
        values = aggregates.individual_values(rows, peptide_nodes, by)
        ratios = pairs.classify_outlier(ratios, pairs.outlier_scores(ratios, links, values, by), by)
        classified = cut(pairs.classify_fold_change(ratios, fold, "outlier_case"), "pairs")
    else:
        classified = cut(pairs.classify_fold_change(ratios, fold).withColumn("outlier_case", F.lit(None).cast("string")), "pairs")

    key = [*by, "peptide_node"]
    ions = rows.join(peptide_nodes, [*by, "peptide_key"]).groupBy(*key).agg(F.sum("ions").alias("ion_count"))
    genes = annotate.gene_strings(protein_nodes, protein, [*by, "protein_node"])
    net_nodes = network.peptide_node_attributes(final, table.select(*key, "n_connected", "n_proteins"), ions, by, fdr_threshold)
    named = final.withColumnRenamed("species", "taxonomy").withColumn("log2_ratio", F.coalesce("log2_ratio", F.lit(float("nan"))))
    results = {
        "psm": reports.psm_table(rows, None, by, psm_protein),
        "peptides": reports.peptide_table(rows, by, edges),
        "peptide_nodes": table,
        "final": final,
        "pairs": reports.pair_table(classified, links, protein, protein_nodes, by, fold),
        "pair_fdr": pairs.pair_fdr(classified, by),
        "summary": aggregates.summary(named, by, fdr_threshold),
        "clusters": nodes.cluster_sizes(cluster_of, protein_nodes, edges, by),
        "discarded": filters.discarded(log, by),
        "net_peptide_nodes": net_nodes,
        "net_protein_nodes": network.protein_node_attributes(links, protein_nodes, peptide_nodes, classified, genes, by),
        "net_edges": network.edge_table(links, table, by),
        "net_significant": network.significant_clusters(net_nodes, by),
    }
    if similar is not None:
        results["alignments"] = similar
    return results


def compare_sites(
    table: DataFrame, samples: Sequence[str], method: str = "BY", q_max: float = 0.05, limit: float | None = None, **options
) -> dict[str, DataFrame]:
    """Pairwise comparison of all samples of a long site table (site_key, sample, log2_ratio, sd, n_meas)."""
    aligned = cut(sites.align_sites(table, samples), "aligned")
    tests = cut(sites.adjusted_tests(sites.pairwise_tests(aligned, **options), method), "tests")
    per_site = sites.discoveries(tests, q_max)
    return {
        "tests": tests,
        "sites": reports.site_ratio_table(aligned, tests, per_site, samples, limit),
        "ratios": reports.total_ratio_matrix(aligned, samples),
        "pair_discoveries": sites.pair_discoveries(tests, q_max),
        "histogram": sites.discovery_histogram(per_site),
        "quantified": sites.quantified_site_counts(aligned),
    }


def compare_groups(
    table: DataFrame, membership: DataFrame, samples: Sequence[str], rounds: int = 999, seed: int = 1, q_max: float = 0.05, **options
) -> DataFrame:
    """Two-group comparisons with the mean number of significant sites of random groups of the same sizes."""
    aligned = cut(sites.align_sites(table, samples), "aligned")
    tests = cut(groups.group_compare(aligned, membership, **options), "tests")
    by_chance = groups.permutation_summary(groups.permutation_counts(aligned, membership, rounds, seed, threshold=q_max, **options))
    return reports.group_table(tests, groups.significant_sites(tests, threshold=q_max), by_chance)


def compare_channels(
    amounts: DataFrame, psm_sites: DataFrame, channel_names: Sequence[str], ignore_not_found: bool = False, method: str = "BY"
) -> DataFrame:
    """Isobaric channels from intensities to corrected tail probabilities of every site in every channel pair."""
    pairs_of = channels.channel_pairs(amounts, channel_names, ignore_not_found=ignore_not_found)
    rows = pairs_of.join(psm_sites, "psm_id")
    return channels.gaussian_pvalues(aggregates.ratio_by(rows, ["site_key", *channels.PAIR]), method=method)


def compare_final_tables(spark: SparkSession, paths: Mapping[str, str], kind: str, fdr_max: float) -> DataFrame:
    """Which of several final tables hold each key within the FDR."""
    return datasets.regions(readers.compare_datasets(spark, paths, kind, fdr_max), list(paths))

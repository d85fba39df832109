"""Network tables: typed node and edge attributes, significant clusters, pair cases and colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquant.functions.texts import clamped
from netquant.operators import nodes
from netquant.operators.aggregates import significant


def peptide_node_attributes(
    final: DataFrame, counts: DataFrame, ions: DataFrame, by: Sequence[str] = (), fdr_threshold: float = 0.05
) -> DataFrame:
    """Peptide nodes of the final table with counts, ions, significance, weight, variance and colour.

    ``counts`` are the node counts, ``ions`` is (peptide_node, ion_count).
    """
    key = [*by, "peptide_node"]
    sig = significant("fdr", "log2_ratio", fdr_threshold)
    extra = counts.select(*key, "n_connected", "n_proteins")
    return final.join(extra, key).join(ions, key, "left").select(
        *key, "cluster_id", "n_proteins", "n_psms", "n_runs", "n_replicates", "n_peptides", "n_connected", "species",
        "ion_count", F.lit(False).alias("is_protein"), (F.col("filtered") != "").alias("is_filtered"),
        F.col("log2_ratio").alias("final_ratio"), "fdr", sig.alias("significant"), "weight", "variance",
        (F.col("n_proteins") == 1).alias("unique_peptide"), (F.col("n_connected") == 1).alias("unique_peptide_node"),
        F.when(sig, clamped("log2_ratio")).alias("colour_value"),
    )


def protein_node_attributes(
    links: DataFrame, protein_members: DataFrame, peptide_members: DataFrame, classified: DataFrame,
    annotation: DataFrame, by: Sequence[str] = (),
) -> DataFrame:
    """Protein nodes: counts, pair cases, annotation strings and the two conclusive flags.

    A node is conclusive with a peptide node of its own, a protein with exactly one peptide.
    """
    by = list(by)
    key = [*by, "protein_node"]
    sizes = protein_members.groupBy(*key).agg(F.count("*").alias("n_proteins"))
    peptides = peptide_members.groupBy(*by, "peptide_node").agg(F.count("*").alias("_peptides"))
    around = links.join(peptides, [*by, "peptide_node"]).groupBy(*key).agg(
        F.count("*").alias("n_peptide_nodes"), F.sum("_peptides").alias("n_peptides")
    )
    own = nodes.unique_peptide_nodes(links, by).groupBy(*key).agg(F.count("*").alias("n_unique_nodes"))
    one = classified.select(*by, F.col("node_1").alias("protein_node"), "fold_case")
    two = classified.select(*by, F.col("node_2").alias("protein_node"), "fold_case")
    cases = nodes.joined_list(one.union(two), key, "fold_case", "cases", ",")
    return (
        around.join(sizes, key)
        .join(own, key, "left")
        .join(cases, key, "left")
        .join(annotation, key, "left")
        .withColumns(
            {
                "n_unique_nodes": F.coalesce("n_unique_nodes", F.lit(0)),
                "cases": F.coalesce("cases", F.lit("")),
                "conclusive_node": F.coalesce("n_unique_nodes", F.lit(0)) > 0,
                "conclusive_protein": F.col("n_peptides") == 1,
                "is_protein": F.lit(True),
            }
        )
    )


def edge_table(
    links: DataFrame, ratios: DataFrame, by: Sequence[str] = (), alignments: DataFrame | None = None
) -> DataFrame:
    """Edges ``(source, target, kind, edge_ratio)``: unique, shared and alignment, one per unordered pair."""
    by = list(by)
    degrees = nodes.node_degrees(links, "peptide_node", by)
    kinds = links.join(degrees, [*by, "peptide_node"]).join(ratios.select(*by, "peptide_node", "log2_ratio"), [*by, "peptide_node"], "left")
    edges = kinds.select(
        *by, F.col("peptide_node").alias("source"), F.col("protein_node").alias("target"),
        F.when(F.col("n_connected") == 1, "unique").otherwise("shared").alias("kind"), F.col("log2_ratio").alias("edge_ratio"),
    )
    if alignments is None:
        return edges
    similar = alignments.select(
        *by, F.least("peptide_1", "peptide_2").alias("source"), F.greatest("peptide_1", "peptide_2").alias("target"),
        F.lit("alignment").alias("kind"), F.lit(None).cast("double").alias("edge_ratio"),
    ).dropDuplicates([*by, "source", "target"])
    return edges.unionByName(similar)


def significant_clusters(peptide_nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Nodes of the clusters that hold a significant node."""
    key = [*by, "cluster_id"]
    kept = peptide_nodes.filter("significant").select(*key).distinct()
    return peptide_nodes.join(kept, key, "left_semi")


def clusters_by_case(
    classified: DataFrame, cluster_of: DataFrame, by: Sequence[str] = (), column: str = "fold_case", skip: str = "CASE6"
) -> DataFrame:
    """``(by, case, cluster_id)``: clusters holding a pair of each case, but for the skipped one."""
    by = list(by)
    rows = classified.filter(F.col(column).isNotNull() & (F.col(column) != skip)).select(
        *by, F.col("node_1").alias("protein_acc"), F.col(column).alias("case")
    ).distinct()
    return rows.join(cluster_of, [*by, "protein_acc"]).select(*by, "case", "cluster_id").distinct()


def colour_values(
    rows: DataFrame, ratio: str = "log2_ratio", low: float = -10.0, high: float = 10.0, flat: float | None = None
) -> DataFrame:
    """Colour value of each ratio; ``flat`` is the value of rows that are not significant."""
    value = clamped(ratio, low, high)
    if flat is not None:
        value = F.when(F.col("significant"), value).otherwise(F.lit(flat))
    return rows.withColumn("colour_value", value)


def taxon_colours(nodes_with_taxa: DataFrame, colours: dict[str, str], other: str = "none") -> DataFrame:
    """Colour of each node by its species string."""
    colour = F.lit(other)
    for taxon, name in colours.items():
        colour = F.when(F.col("species") == taxon, name).otherwise(colour)
    return nodes_with_taxa.withColumn("taxon_colour", colour)

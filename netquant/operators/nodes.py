"""Nodes: proteins (or peptides) that cannot be told apart because they have the same neighbours.

The class that holds this logic is missing from the material this library follows, so the wiring
is inferred; all those choices live in this module. A node is named by its least member, which
is unique because the nodes partition the members.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def peptide_protein_edges(psm: DataFrame, psm_protein: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Distinct ``(by, peptide_key, protein_acc)``; the proteins of a peptide are those of its PSMs."""
    by = list(by)
    if psm_protein is None:
        return psm.select(*by, "peptide_key", "protein_acc").distinct()
    return psm.select(*by, "psm_id", "peptide_key").join(psm_protein, [*by, "psm_id"]).select(
        *by, "peptide_key", "protein_acc"
    ).distinct()


def _same_neighbours(edges: DataFrame, member: str, neighbour: str, node: str, by: list[str]) -> DataFrame:
    """Group members by a signature of their neighbour set.

    The signature is the set size with two independent 64-bit hashes of the set, built by a
    commutative aggregate: a hub never gathers its neighbours in one place. Two sets agree by
    chance with probability 2**-128; ``collapse_conflicts`` checks a result exactly. Members of one
    signature meet in one task, which sorts them by it and spills; they are exchanged once.
    """
    signed = edges.groupBy(*by, member).agg(
        F.count("*").alias("_size"),
        F.bit_xor(F.xxhash64(F.lit(1), F.col(neighbour))).alias("_hash_1"),
        F.bit_xor(F.xxhash64(F.lit(2), F.col(neighbour))).alias("_hash_2"),
    )
    for c in by:
        signed = signed.filter(F.col(c).isNotNull())
    alike = Window.partitionBy(*by, "_size", "_hash_1", "_hash_2")
    return signed.select(*by, member, F.min(member).over(alike).alias(node))


def collapse_proteins(edges: DataFrame, by: Sequence[str] = (), on: bool = True) -> DataFrame:
    """``(by, protein_acc, protein_node)``; with ``on=False`` every protein is its own node."""
    by = list(by)
    if not on:
        return edges.select(*by, "protein_acc").distinct().withColumn("protein_node", F.col("protein_acc"))
    return _same_neighbours(edges, "protein_acc", "peptide_key", "protein_node", by)


def collapse_peptides(edges: DataFrame, by: Sequence[str] = (), on: bool = True) -> DataFrame:
    """``(by, peptide_key, peptide_node)``; with ``on=False`` every peptide is its own node."""
    by = list(by)
    if not on:
        return edges.select(*by, "peptide_key").distinct().withColumn("peptide_node", F.col("peptide_key"))
    return _same_neighbours(edges, "peptide_key", "protein_acc", "peptide_node", by)


def collapse_conflicts(
    edges: DataFrame, members: DataFrame, member: str, neighbour: str, node: str, by: Sequence[str] = ()
) -> DataFrame:
    """Edges of a node's least member that another member lacks, or the reverse; empty when exact."""
    by = list(by)
    others = members.filter(F.col(member) != F.col(node))
    own = others.join(edges, [*by, member]).select(*by, member, node, neighbour)
    least = edges.select(*by, F.col(member).alias(node), neighbour)
    expected = others.join(least, [*by, node]).select(*by, member, node, neighbour)
    keys = [*by, member, node, neighbour]
    return own.join(expected, keys, "left_anti").union(expected.join(own, keys, "left_anti"))


def node_edges(
    edges: DataFrame,
    peptide_nodes: DataFrame,
    protein_nodes: DataFrame,
    by: Sequence[str] = (),
    indistinguishable: bool = True,
) -> DataFrame:
    """Distinct ``(by, peptide_node, protein_node)``.

    Members of indistinguishable nodes have equal neighbours, so the edges between least members
    are the node edges: two semi joins and no distinct. Site and PTM nodes need the general form.
    """
    by = list(by)
    if indistinguishable:
        peptides = peptide_nodes.filter("peptide_key = peptide_node").select(*by, "peptide_key")
        proteins = protein_nodes.filter("protein_acc = protein_node").select(*by, "protein_acc")
        # Nearly every peptide is a node but many proteins are not: those leave first.
        kept = edges.join(proteins, [*by, "protein_acc"], "left_semi").join(peptides, [*by, "peptide_key"], "left_semi")
        return kept.select(*by, F.col("peptide_key").alias("peptide_node"), F.col("protein_acc").alias("protein_node"))
    return (
        edges.join(peptide_nodes, [*by, "peptide_key"])
        .join(protein_nodes, [*by, "protein_acc"])
        .select(*by, "peptide_node", "protein_node")
        .distinct()
    )


def node_degrees(links: DataFrame, node: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by, node, n_connected)``."""
    return links.groupBy(*by, node).agg(F.count("*").alias("n_connected"))


def unique_peptide_nodes(links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, peptide_node, protein_node)`` of the peptide nodes with exactly one protein node."""
    return (
        links.groupBy(*by, "peptide_node")
        .agg(F.count("*").alias("_n"), F.min("protein_node").alias("protein_node"))
        .filter("_n = 1")
        .drop("_n")
    )


def joined_list(df: DataFrame, keys: Sequence[str], value: str, out: str, sep: str = " ") -> DataFrame:
    """Sorted distinct values of each group joined into one text cell, whatever their number.

    Sets combine map-side, so a task receives each value at most once per map task. The cell is a text of an output table:
    operators that only compare sets use size and hashes instead.
    """
    listed = F.concat_ws(sep, F.array_sort(F.collect_set(value)).cast("array<string>"))
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(listed.alias(out))


def node_keys(members: DataFrame, member: str, node: str, by: Sequence[str] = (), sep: str = " ") -> DataFrame:
    """``(by, node, node_key)``: sorted member keys joined by a space."""
    return joined_list(members, [*by, node], member, "node_key", sep)


def node_proteins(members: DataFrame, links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, peptide_node, protein_acc)``: the individual proteins of each peptide node."""
    by = list(by)
    return links.join(members, [*by, "protein_node"]).select(*by, "peptide_node", "protein_acc").distinct()


def cluster_sizes(
    cluster_of: DataFrame, protein_nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Per cluster: proteins, protein nodes, peptides."""
    by = list(by)
    proteins = (
        cluster_of.join(protein_nodes, [*by, "protein_acc"])
        .groupBy(*by, "cluster_id")
        .agg(
            F.count("*").alias("n_proteins"),
            F.count_if(F.col("protein_acc") == F.col("protein_node")).alias("n_protein_nodes"),
        )
    )
    peptides = (
        edges.groupBy(*by, "peptide_key")
        .agg(F.min("protein_acc").alias("protein_acc"))
        .join(cluster_of, [*by, "protein_acc"])
        .groupBy(*by, "cluster_id")
        .agg(F.count("*").alias("n_peptides"))
    )
    return proteins.join(peptides, [*by, "cluster_id"])


def single_cluster_counts(sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many clusters hold one protein, one protein node or several."""
    return sizes.groupBy(*by).agg(
        F.count("*").alias("n_clusters"),
        F.count_if(F.col("n_proteins") == 1).alias("n_one_protein"),
        F.count_if(F.col("n_protein_nodes") == 1).alias("n_one_protein_node"),
        F.count_if(F.col("n_protein_nodes") > 1).alias("n_many_protein_nodes"),
    )

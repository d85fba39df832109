"""Protein clusters: connected components of the peptide-protein graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquant.lineage import cut


def connected_components(
    links: DataFrame, left: str, right: str, by: Sequence[str] = (), max_rounds: int = 200
) -> DataFrame:
    """``(by, vertex, component)`` for every vertex of an undirected edge list; component = least vertex.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each round points every
    vertex to the least one around it, so the number of rounds grows with the logarithm of the
    component size, also on one giant component. A step is a map-side combined ``min`` and one
    equi-join whose hot keys (the roots) hold a single row on the other side, the shape that the
    skew join rule splits. Before each step the leaves leave: a vertex with one neighbour, a lesser
    one, only remembers it. A finished star is all leaves, so a round holds the unfinished rest and
    the last one is empty. Afterwards the leaves take their neighbour's component, last round first.
    Each round is written, so no lineage builds up.
    """
    by = list(by)
    # Read three times below: for both ends of the vertex list and for the numbering.
    links = cut(links.select(*by, left, right), "links")
    vertices = (
        links.select(*by, F.col(left).alias("vertex"))
        .union(links.select(*by, F.col(right).alias("vertex")))
        .distinct()
    )
    ids = _numbered(vertices, by)
    return _named(ids, _roots(_as_ids(links, left, right, ids, by), max_rounds), by)


def _roots(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(u, v)``: the least vertex v around every other vertex u of distinct edges u > v."""
    edges = cut(edges, "links")
    rounds = []
    for _ in range(max_rounds):
        parted = _leaves_marked(edges)
        rounds.append(parted.filter("leaf").select("u", "v"))
        rest = parted.filter("not leaf").select("u", "v")
        if rest.isEmpty():
            break
        edges = cut(_small_star(_large_star(rest)), "star")
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    return _expanded(rounds)


def _named(ids: DataFrame, roots: DataFrame, by: list[str]) -> DataFrame:
    """``(by, vertex, component)`` of all numbered vertices; one without a root is its own."""
    names = ids.select("id", F.col("vertex").alias("component"))
    placed = ids.join(roots.withColumnRenamed("u", "id"), "id", "left").select(
        *by, "vertex", F.coalesce("v", "id").alias("id")
    )
    return placed.join(names, "id").select(*by, "vertex", "component")


def _numbered(vertices: DataFrame, by: list[str]) -> DataFrame:
    """Long ids in the order of (by, vertex), so that the rounds move two longs per edge.

    Range partitions sorted inside are numbered by partition and row: the ids keep the order with
    no global sort in one place. They are written, as a second computation could number otherwise.
    """
    ordered = vertices.repartitionByRange(*by, "vertex").sortWithinPartitions(*by, "vertex")
    return cut(ordered.withColumn("id", F.monotonically_increasing_id()), "vertices")


def _as_ids(links: DataFrame, left: str, right: str, ids: DataFrame, by: list[str]) -> DataFrame:
    """Distinct (u, v) with u > v."""
    one = ids.select(*by, F.col("vertex").alias(left), F.col("id").alias("_a"))
    two = ids.select(*by, F.col("vertex").alias(right), F.col("id").alias("_b"))
    numbered = links.filter(F.col(left) != F.col(right)).join(one, [*by, left]).join(two, [*by, right])
    return numbered.select(F.greatest("_a", "_b").alias("u"), F.least("_a", "_b").alias("v")).distinct()


def _leaves_marked(edges: DataFrame) -> DataFrame:
    """Edges with ``leaf``: whether u has no other edge, so that removing it parts nothing and leaves the least vertex."""
    ends = edges.select("u").union(edges.select(F.col("v").alias("u")))
    single = ends.groupBy("u").agg(F.count("*").alias("_n")).filter("_n = 1").select("u", F.lit(True).alias("leaf"))
    return cut(edges.join(single, "u", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False))), "leaves")


def _expanded(rounds: list[DataFrame]) -> DataFrame:
    """``(u, v)``: the root v of every removed u. A leaf's neighbour is a root or was removed in a later round."""
    found = rounds[-1]
    for i in range(len(rounds) - 2, -1, -1):
        later = found.select(F.col("u").alias("v"), F.col("v").alias("_root"))
        here = rounds[i].join(later, "v", "left").select("u", F.coalesce("_root", "v").alias("v"))
        # The first round is read once, by the caller.
        found = found.union(cut(here, "roots") if i else here)
    return found


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every greater neighbour of u to the least vertex around u."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.filter(F.col("v") > F.col("u")).join(least, "u")
    # One row per edge; repeated ones leave in the distinct of the small star.
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its lesser neighbours to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def _peptide_ids(edges: DataFrame, ids: DataFrame, by: list[str]) -> DataFrame:
    """``(by, peptide_key, id, least)``: each edge with the number of its protein and the least one of its peptide.

    Peptides contract to links from each of their proteins to the least one: same components on the protein side
    with no peptide vertices, and a peptide of k proteins gives k links, never k*k.
    """
    numbered = cut(edges.join(ids.withColumnRenamed("vertex", "protein_acc"), [*by, "protein_acc"]).select(*by, "peptide_key", "id"), "numbered")
    least = numbered.groupBy(*by, "peptide_key").agg(F.min("id").alias("least"))
    return numbered.join(least, [*by, "peptide_key"])


def _similar_ids(numbered: DataFrame, alignments: DataFrame, by: list[str]) -> DataFrame:
    """``(a, b)``: the least proteins of two similar peptides (``peptide_1``, ``peptide_2``)."""
    least = numbered.groupBy(*by, "peptide_key").agg(F.min("id").alias("least"))
    one = least.select(*by, F.col("peptide_key").alias("peptide_1"), F.col("least").alias("a"))
    two = least.select(*by, F.col("peptide_key").alias("peptide_2"), F.col("least").alias("b"))
    keys = [c for c in by if c in alignments.columns]
    pairs = alignments.select(*keys, "peptide_1", "peptide_2")
    return pairs.join(one, [*keys, "peptide_1"]).join(two, [*by, "peptide_2"]).select("a", "b")


def clusters(edges: DataFrame, by: Sequence[str] = (), alignments: DataFrame | None = None) -> DataFrame:
    """``(by, protein_acc, cluster_id)``; a cluster is named by its least protein accession.

    Proteins are numbered first, in the order of their keys, so that a peptide's least one is a hashed ``min`` of longs.
    """
    by = list(by)
    used = edges.filter(F.col("peptide_key").isNotNull())
    for c in by:
        used = used.filter(F.col(c).isNotNull())
    ids = _numbered(used.select(*by, F.col("protein_acc").alias("vertex")).distinct(), by)
    numbered = _peptide_ids(used, ids, by)
    links = numbered.select(F.col("id").alias("a"), F.col("least").alias("b"))
    if alignments is not None:
        links = links.union(_similar_ids(numbered, alignments, by))
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    return _named(ids, _roots(pairs), by).select(
        *by, F.col("vertex").alias("protein_acc"), F.col("component").alias("cluster_id")
    )


def cluster_peptides(edges: DataFrame, cluster_of: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, cluster_id, peptide_key)``, one row per peptide: all its proteins share a cluster."""
    by = list(by)
    one = edges.groupBy(*by, "peptide_key").agg(F.min("protein_acc").alias("protein_acc"))
    return one.join(cluster_of, [*by, "protein_acc"]).select(*by, "cluster_id", "peptide_key")


def duplicate_cluster_peptides(edges: DataFrame, cluster_of: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Peptides found in more than one cluster; empty on a correct clustering.

    Every edge is looked at by a 64-bit hash of its cluster, whose least and greatest value combine in a hash table; the
    names are compared for the few peptides whose hashes differ. Two clusters of a peptide agree by chance with probability 2**-64.
    """
    by = list(by)
    key = [*by, "peptide_key"]
    placed = edges.join(cluster_of, [*by, "protein_acc"]).select(*key, "cluster_id")
    spread = placed.select(*key, F.xxhash64("cluster_id").alias("_h")).groupBy(*key).agg(F.min("_h").alias("_least"), F.max("_h").alias("_most"))
    several = cut(spread.filter("_least <> _most").select(*[F.col(c).alias(f"_{c}") for c in key]), "several")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return (
        placed.join(several, same, "left_semi")
        .groupBy(*key)
        .agg(F.min("cluster_id").alias("first_cluster"), F.max("cluster_id").alias("last_cluster"))
        .filter(F.col("first_cluster") != F.col("last_cluster"))
    )


def cluster_vertices(edges: DataFrame, cluster_of: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, vertex, kind, cluster_id)`` over proteins and peptides."""
    by = list(by)
    proteins = cluster_of.select(*by, F.col("protein_acc").alias("vertex"), F.lit("protein").alias("kind"), "cluster_id")
    peptides = cluster_peptides(edges, cluster_of, by).select(
        *by, F.col("peptide_key").alias("vertex"), F.lit("peptide").alias("kind"), "cluster_id"
    )
    return proteins.union(peptides)

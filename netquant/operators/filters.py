"""Filters on PSMs, peptides and peptide nodes, with a log of what was discarded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquant.functions.ratios import is_finite, is_inf
from netquant.lineage import cut
from netquant.operators.nodes import collapse_peptides

# Reasons of the discard log (fixed values).
CONTAINING_PTM = "CONTAINING_PTM"
NOT_CONTAINING_PTM = "NOT_CONTAINING_PTM"
PEPTIDE_WITH_NO_PROTEIN = "PEPTIDE_WITH_NO_PROTEIN"
FILTERED_NODE = "FILTERED_NODE"


def restrict_to_observed(digest: DataFrame, psm: DataFrame, key: str = "peptide_key") -> DataFrame:
    """Inclusion list: index rows of sequences seen in any input."""
    return digest.join(psm.select(key), key, "left_semi")


def drop_modified(psm: DataFrame) -> DataFrame:
    """PSMs of unmodified peptides (``has_ptm`` false)."""
    return psm.filter(~F.col("has_ptm"))


def drop_orphans(peptides: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Peptides connected to at least one protein."""
    return peptides.join(edges.select(*by, "peptide_key"), [*by, "peptide_key"], "left_semi")


def discarded(
    reasons: Sequence[tuple[DataFrame, str, str]], by: Sequence[str] = ()
) -> DataFrame:
    """Union of discarded peptide sets: each item is (rows with ``peptide_key``, reason, detail)."""
    parts = [
        rows.select(*by, "peptide_key").distinct().select(
            *by, "peptide_key", F.lit(reason).alias("reason"), F.lit(detail).alias("detail")
        )
        for rows, reason, detail in reasons
    ]
    log = parts[0]
    for part in parts[1:]:
        log = log.unionByName(part)
    return log


def drop_decoys(edges: DataFrame, pattern: str | None, column: str = "protein_acc") -> DataFrame:
    """Remove accessions matching the decoy pattern; no pattern, no removal."""
    return edges if not pattern else edges.filter(~F.col(column).rlike(pattern))


def keep_peptides(rows: DataFrame, pattern: str | None, column: str = "peptide_key") -> DataFrame:
    """Keep sequences matching the pattern; no pattern keeps all."""
    return rows if not pattern else rows.filter(F.col(column).rlike(pattern))


def drop_singletons(psm: DataFrame) -> DataFrame:
    return psm.filter(~F.col("singleton"))


def one_per_peak(
    psm: DataFrame, peak: Sequence[str], by: Sequence[str] = (), score: str = "score"
) -> DataFrame:
    """Best-scored PSM of each chromatographic peak; ties go to the least psm_id.

    An aggregate of the best (score, id) keeps one row per peak in each task, where a row number
    over the peak would sort all its PSMs in one.
    """
    keys = [*by, *peak]
    best = psm.groupBy(*keys).agg(F.max(score).alias("_score"))
    tied = psm.join(best, keys).filter(F.col(score) == F.col("_score"))
    winner = tied.groupBy(*keys).agg(F.min("psm_id").alias("psm_id"))
    return psm.join(winner.select(*by, "psm_id"), [*by, "psm_id"], "left_semi")


def is_quantified(c: Column | str) -> Column:
    """A ratio that is a number or an infinity."""
    return is_finite(c) | is_inf(c)


def node_filter_counts(psm: DataFrame, members: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per peptide node: ions, PSMs, replicates, peptides and whether anything was quantified."""
    by = list(by)
    key = [*by, "peptide_node"]
    counts = psm.join(members, [*by, "peptide_key"]).groupBy(*key).agg(
        F.sum("ions").alias("n_ions"),
        F.count("*").alias("n_psms"),
        F.size(F.collect_set("replicate")).alias("n_replicates"),  # as many as input files at most
        F.coalesce(F.bool_or(is_quantified("log2_ratio")), F.lit(False)).alias("quantified"),
    )
    return counts.join(members.groupBy(*key).agg(F.count("*").alias("n_peptides")), key)


def node_predicate(
    min_ions: int | None = None,
    min_psms: int | None = None,
    min_replicates: int | None = None,
    predicate: Column | None = None,
) -> Column:
    """Nodes to keep; a node with no quantified member passes every count filter."""
    accepted = F.lit(True)
    for column, least in (("n_ions", min_ions), ("n_psms", min_psms), ("n_replicates", min_replicates)):
        if least is not None:
            accepted = accepted & (F.col(column) >= least)
    accepted = ~F.col("quantified") | accepted
    return accepted if predicate is None else accepted & predicate


def filter_nodes(counts: DataFrame, remove: bool = True, **limits) -> DataFrame:
    """Node counts of the accepted nodes, or all with a ``filtered`` flag when only tagging."""
    accepted = node_predicate(**limits)
    return counts.filter(accepted) if remove else counts.withColumn("filtered", ~accepted)


def filter_report(counts: DataFrame, by: Sequence[str] = (), **limits) -> DataFrame:
    """Nodes removed by each filter on its own."""
    columns = [
        F.count_if(~node_predicate(**{name: least})).alias(f"removed_{name}")
        for name, least in limits.items()
        if least is not None
    ]
    return counts.groupBy(*by).agg(F.count("*").alias("n_nodes"), *columns)


def apply_node_filters(
    psm: DataFrame, edges: DataFrame, members: DataFrame, by: Sequence[str] = (), **limits
) -> tuple[DataFrame, DataFrame]:
    """Surviving ``(psm, edges)``: a lost node takes its peptides, their PSMs, and proteins left bare."""
    by = list(by)
    kept = filter_nodes(node_filter_counts(psm, members, by), **limits).select(*by, "peptide_node")
    peptides = members.join(kept, [*by, "peptide_node"], "left_semi").select(*by, "peptide_key")
    return (
        psm.join(peptides, [*by, "peptide_key"], "left_semi"),
        edges.join(peptides, [*by, "peptide_key"], "left_semi"),
    )


def filter_to_fixpoint(
    psm: DataFrame, edges: DataFrame, by: Sequence[str] = (), remove: bool = True, max_rounds: int = 50, **limits
) -> tuple[DataFrame, DataFrame]:
    """Collapse and filter again until a round removes no edge; tagging needs a single round.

    An error if ``max_rounds`` rounds do not reach that state.
    """
    psm, edges = cut(psm, "psm"), cut(edges, "edges")
    before = edges.count()
    for _ in range(max_rounds if remove else 1):
        members = collapse_peptides(edges, by)
        psm, edges = apply_node_filters(psm, edges, members, by, **limits)
        psm, edges = cut(psm, "psm"), cut(edges, "edges")
        after = edges.count()
        if after == before or not remove:
            return psm, edges
        before = after
    raise RuntimeError(f"filters not stable after {max_rounds} rounds")


def ptm_matches(ptm: Column, specs: Sequence[tuple[float | None, str | None]]) -> Column:
    """Does a ``struct(aa, delta_mass, ...)`` match any spec; a missing mass or residue list matches all."""
    found = F.lit(False)
    for mass, residues in specs:
        match = F.lit(True)
        if mass is not None:
            match = match & (ptm["delta_mass"] == F.lit(float(mass)))
        if residues:
            match = match & F.lit(residues).contains(ptm["aa"])
        found = found | match
    return found


def keep_ptm(peptides: DataFrame, specs: Sequence[tuple[float | None, str | None]], ptms: str = "ptms") -> DataFrame:
    """Peptides holding at least one modification named by the specs."""
    return peptides.filter(F.exists(F.col(ptms), lambda ptm: ptm_matches(ptm, specs)))

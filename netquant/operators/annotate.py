"""Protein annotation joined to nodes: genes, species, descriptions, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquant.functions.texts import DESCRIPTION_SEPARATOR, LONGEST_LABEL
from netquant.operators.nodes import joined_list


def annotate(rows: DataFrame, protein: DataFrame, *columns: str) -> DataFrame:
    """Left join of the annotation by accession; the join strategy follows its measured size."""
    kept = columns or tuple(c for c in protein.columns if c != "protein_acc")
    return rows.join(protein.select("protein_acc", *kept), "protein_acc", "left")


def _allowed(column: str, taxa: Sequence[str] | None, any_case: bool) -> Column:
    if not taxa:
        return F.lit(True)
    text = F.lower(column) if any_case else F.col(column)
    found = F.lit(False)
    for taxon in taxa:
        found = found | text.contains(taxon.lower() if any_case else taxon)
    return found


def gene_strings(
    members: DataFrame, protein: DataFrame, keys: Sequence[str], taxa: Sequence[str] | None = None,
    first_only: bool = False, sep: str = ",",
) -> DataFrame:
    """``(keys, genes)``: sorted distinct gene names, of the allowed taxa in any letter case."""
    rows = annotate(members, protein, "gene", "taxonomy").filter(_allowed("taxonomy", taxa, any_case=True))
    if first_only:
        return rows.groupBy(*keys).agg(F.min("gene").alias("genes"))
    return joined_list(rows, keys, "gene", "genes", sep)


def species_strings(
    members: DataFrame, protein: DataFrame, keys: Sequence[str], taxa: Sequence[str] | None = None, sep: str = ","
) -> DataFrame:
    """``(keys, species)``: sorted distinct species, of the allowed taxa in exact letter case."""
    rows = annotate(members, protein, "taxonomy").filter(_allowed("taxonomy", taxa, any_case=False))
    return joined_list(rows, keys, "taxonomy", "species", sep)


def accession_strings(members: DataFrame, keys: Sequence[str], sep: str = " ") -> DataFrame:
    return joined_list(members, keys, "protein_acc", "accessions", sep)


def protein_strings(links: DataFrame, protein_members: DataFrame, protein: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, peptide_node, accessions, genes, species)`` as of the three functions above, for nodes with an accession; null without a gene or species.

    Proteins are annotated once and gathered by protein node; each link then brings one row of sets, not its proteins three times.
    """
    by = list(by)
    lists = {"protein_acc": ("accessions", " "), "gene": ("genes", ","), "taxonomy": ("species", ",")}
    of_node = annotate(protein_members, protein, "gene", "taxonomy").groupBy(*by, "protein_node").agg(*[F.collect_set(c).alias(c) for c in lists])
    held = links.join(of_node, [*by, "protein_node"]).groupBy(*by, "peptide_node").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in lists])
    texts = {out: F.when(F.size(c) > 0, F.concat_ws(sep, F.array_sort(F.array_distinct(c)).cast("array<string>"))) for c, (out, sep) in lists.items()}
    return held.filter(F.size("protein_acc") > 0).select(*by, "peptide_node", *[text.alias(out) for out, text in texts.items()])


def description_strings(members: DataFrame, protein: DataFrame, keys: Sequence[str]) -> DataFrame:
    return joined_list(annotate(members, protein, "description"), keys, "description", "descriptions", DESCRIPTION_SEPARATOR)


def annotation_columns(members: DataFrame, protein: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """User-chosen annotation columns: sorted distinct values per node, one column each."""
    rows = annotate(members, protein, *columns)
    result = members.select(*keys).distinct()
    for column in columns:
        result = result.join(joined_list(rows, keys, column, f"{column}_values", ","), list(keys), "left")
    return result


def xml_annotation(column: Column | str, path: str) -> Column:
    """Values at a path of an annotation kept as XML text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array_sort(F.array_distinct(F.xpath(c, F.lit(path))))


def node_labels(nodes: DataFrame, label: str, node: str = "protein_node") -> DataFrame:
    """Label of each protein node; one longer than the limit becomes ``Prot_`` and its node id.

    The id names the node in place of a running number, which would need a global order.
    """
    long = F.length(label) > LONGEST_LABEL
    return nodes.withColumn("label", F.when(long, F.concat(F.lit("Prot_"), F.col(node))).otherwise(F.col(label)))

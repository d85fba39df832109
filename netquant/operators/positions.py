"""Digestion, positions of residues and modifications in proteins, and interval tests on them."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator, Sequence
from itertools import chain, islice, zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquant.functions.sequences import cleave, ptm_code, residue_positions, semi_forms
from netquant.lineage import cut
from netquant.operators.nodes import joined_list

# Width of the position buckets of the interval join; any width gives the same rows.
BUCKET = 64
# Letters by which peptides are looked up in a sequence; any number gives the same rows.
ANCHOR = 4
# Occurrences given back at once; any number gives the same rows.
ROWS = 65536


def digest(
    proteins: DataFrame,
    enzyme: str = "KR",
    missed: int = 0,
    semi: bool = False,
    min_length: int = 1,
    max_length: int | None = None,
    pattern: str | None = None,
    observed: DataFrame | None = None,
) -> DataFrame:
    """Distinct ``(peptide_key, protein_acc)`` of the in-silico peptides of each protein sequence.

    ``observed`` is an inclusion list of sequences; it restricts the index before it is shuffled.
    """
    peptides = proteins.select("protein_acc", F.explode(cleave("sequence", enzyme, missed)).alias("peptide_key"))
    if semi:
        peptides = peptides.select("protein_acc", F.explode(semi_forms("peptide_key")).alias("peptide_key"))
    kept = F.length("peptide_key") >= min_length
    if max_length is not None:
        kept = kept & (F.length("peptide_key") <= max_length)
    if pattern:
        kept = kept & F.col("peptide_key").rlike(pattern)
    peptides = peptides.filter(kept)
    if observed is not None:
        peptides = peptides.join(observed.select("peptide_key"), "peptide_key", "left_semi")
    return peptides.distinct()


def missing_peptides(psm: DataFrame, index: DataFrame) -> DataFrame:
    """Observed peptides absent from the index; an error for callers that do not ignore them."""
    return psm.select("peptide_key").distinct().join(index, "peptide_key", "left_anti")


def places(sequence: str, peptides: Sequence[str]) -> Iterator[tuple[str, int]]:
    """(peptide, 1-based start) of every occurrence, overlapping ones included, in one pass over the sequence.

    Peptides are looked up by their first ``ANCHOR`` letters, shorter ones whole.
    """
    anchored: dict[str, list[str]] = {}
    for peptide in filter(None, peptides):
        anchored.setdefault(peptide[:ANCHOR], []).append(peptide)
    widths = sorted({len(anchor) for anchor in anchored})
    for start in range(len(sequence)):
        for width in widths:
            if start + width <= len(sequence):
                for peptide in anchored.get(sequence[start : start + width], ()):
                    if sequence.startswith(peptide, start):
                        yield peptide, start + 1


def places_at_ends(sequences: Sequence[str], peptides: Collection[str], enzyme: str = "KR") -> Iterator[tuple[str, int]]:
    """(peptide, 1-based start) of peptides whose only cut is at their end: they lie at the end of a cleaved piece.

    Each end of a piece is looked up whole in the set of peptides. The pieces of several rows of one protein are counted through by their number.
    """
    widths = sorted({len(peptide) for peptide in peptides})
    cutter = re.compile(f"[^{enzyme}]*[{enzyme}]|[^{enzyme}]+")
    stop = 0
    for row in zip_longest(*map(cutter.findall, sequences)):
        for piece in row:
            if piece is None:
                continue
            stop += len(piece)
            for width in widths:
                if width > len(piece):
                    break
                if piece[-width:] in peptides:
                    yield piece[-width:], stop - width + 1


def protein_occurrences(edges: DataFrame, proteins: DataFrame, enzyme: str = "KR") -> DataFrame:
    """``(peptide_key, protein_acc, start, end)`` of every occurrence of an edge's peptide, overlapping ones included.

    The peptides of a protein are laid beside its sequence, so each edge and each sequence moves once and an occurrence never does. A peptide
    whose only cutting letter is its last one can only lie at the end of a cleaved piece and is looked up there; the others (the last one of a
    sequence, missed or partial cleavage) are looked up letter by letter. Letters are compared as they are: a stop sign is a letter. Any
    ``enzyme`` gives the same rows.
    """
    text = F.lit(None).cast("string")
    laid = edges.select("protein_acc", "peptide_key", text.alias("sequence")).unionByName(
        proteins.select("protein_acc", text.alias("peptide_key"), "sequence")
    )
    rows = (
        laid.filter(F.col("protein_acc").isNotNull())
        .groupBy("protein_acc")
        .agg(F.collect_set("peptide_key").alias("peptides"), F.collect_list("sequence").alias("sequences"))
        .filter((F.size("peptides") > 0) & (F.size("sequences") > 0))
    )
    simple = re.compile(f"[^{enzyme}]*[{enzyme}]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            accs, lists, texts = (batch.column(c) for c in ("protein_acc", "peptides", "sequences"))
            for at in range(batch.num_rows):
                acc, peptides, sequences = accs[at].as_py(), set(lists[at].as_py()), texts[at].as_py()
                ends = {peptide for peptide in peptides if simple.fullmatch(peptide)}
                found = chain(places_at_ends(sequences, ends, enzyme), *(places(sequence, peptides - ends) for sequence in sequences))
                while part := list(islice(found, ROWS)):
                    keys, starts = zip(*part)
                    columns = [pa.array(keys, pa.string()), pa.array([acc] * len(part), pa.string()), pa.array(starts, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["peptide_key", "protein_acc", "start"])

    found = rows.mapInArrow(run, "peptide_key string, protein_acc string, start int")
    return found.withColumn("end", F.col("start") + F.length("peptide_key") - 1)


def site_positions(spans: DataFrame, residues: str) -> DataFrame:
    """Each quantified residue of a peptide at each place in a protein."""
    return spans.select(
        "peptide_key", "protein_acc", "start", F.explode(residue_positions("peptide_key", residues)).alias("position")
    ).select(
        "peptide_key",
        "protein_acc",
        "position",
        F.substring("peptide_key", F.col("position"), F.lit(1)).alias("aa"),
        (F.col("start") + F.col("position") - 1).alias("protein_position"),
    )


def ptm_positions(spans: DataFrame, ptms: DataFrame) -> DataFrame:
    """Each modification of a peptide at each place in a protein; ``ptms`` is (peptide_key, position, aa, delta_mass)."""
    return spans.join(ptms, "peptide_key").select(
        "peptide_key", "protein_acc", "position", "aa", "delta_mass",
        (F.col("start") + F.col("position") - 1).alias("protein_position"),
    )


def covering(spans: DataFrame, positions: DataFrame) -> DataFrame:
    """Spans that cover at least one of the protein positions.

    An interval join as an equi-join on (protein, bucket): a span is put in each bucket it touches,
    a position in its own, and the exact test is the residual condition.
    """
    bucketed = spans.withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("end") / BUCKET)))
    )
    marks = positions.select(
        "protein_acc", F.col("protein_position").alias("_at"), F.floor(F.col("protein_position") / BUCKET).alias("_bucket")
    ).distinct()
    hit = (
        (bucketed["protein_acc"] == marks["protein_acc"])
        & (bucketed["_bucket"] == marks["_bucket"])
        & marks["_at"].between(bucketed["start"], bucketed["end"])
    )
    return bucketed.join(marks, hit, "left_semi").drop("_bucket").distinct()


def covers(start: Column, end: Column, positions: Column) -> Column:
    """Does the span hold any position of the array."""
    return F.exists(positions, lambda at: at.between(start, end))


def compatible(state: Column, start: Column, end: Column, own: Column) -> Column:
    """Do a protein state and a peptide agree on the modified positions inside the peptide's span."""
    inside = F.filter(state, lambda at: at.between(start, end))
    return (F.size(F.array_except(inside, own)) == 0) & (F.size(F.array_except(own, state)) == 0)


def same_positions(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def only_first(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def share_any(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def common(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def collapse_by_site(positions: DataFrame) -> DataFrame:
    """``(site_node, site_key, peptide_key, position)``: peptides regrouped by quantified site.

    A peptide belongs to one node per quantified residue; the node is the set of protein positions
    of that residue over all proteins. Sets are compared by size and two 64-bit hashes and named by
    the least (peptide, position); ``site_key`` lists them as ``acc#K15`` joined by ``-``.
    """
    place = F.concat("protein_acc", F.lit("#"), "aa", F.col("protein_position").cast("string"))
    return _collapse_positions(positions.withColumn("_place", place))


def collapse_by_ptm(positions: DataFrame) -> DataFrame:
    """As :func:`collapse_by_site` on modified positions; the mass is part of the position."""
    place = F.concat(
        "protein_acc", F.lit("#"), "aa", F.col("protein_position").cast("string"),
        F.format_string("(%+.2f)", F.col("delta_mass")),
    )
    return _collapse_positions(positions.withColumn("_place", place))


def _collapse_positions(placed: DataFrame) -> DataFrame:
    rows = placed.select("peptide_key", "position", "_place").distinct()
    signature = ["_size", "_hash_1", "_hash_2"]
    signed = rows.groupBy("peptide_key", "position").agg(
        F.count("*").alias("_size"),
        F.bit_xor(F.xxhash64(F.lit(1), F.col("_place"))).alias("_hash_1"),
        F.bit_xor(F.xxhash64(F.lit(2), F.col("_place"))).alias("_hash_2"),
    )
    member = F.struct("peptide_key", "position")
    named = signed.groupBy(*signature).agg(F.min(member).alias("_least"))
    nodes = signed.join(named, signature).select(
        F.concat_ws("@", "_least.peptide_key", F.col("_least.position").cast("string")).alias("site_node"),
        "peptide_key",
        "position",
        (F.col("_least") == member).alias("_first"),
    )
    # The set of the least member is the set of the node.
    least = nodes.filter("_first").select("site_node", "peptide_key", "position").join(rows, ["peptide_key", "position"])
    labels = joined_list(least, ["site_node"], "_place", "site_key", sep="-")
    return nodes.drop("_first").join(labels, "site_node")


def position_strings(positions: DataFrame, by: str = "peptide_key") -> DataFrame:
    """``P#K15#K18`` per protein, proteins joined by ``-``: where a peptide's residues lie."""
    place = F.concat("aa", F.col("protein_position").cast("string"))
    per_protein = joined_list(positions.withColumn("_place", place), [by, "protein_acc"], "_place", "_places", sep="#")
    text = F.concat_ws("#", "protein_acc", "_places")
    return joined_list(per_protein.withColumn("_text", text), [by], "_text", "positions", sep="-")


def peptide_position_strings(positions: DataFrame) -> DataFrame:
    """Positions inside the peptide, ``SEQ#K3#K7``."""
    place = F.concat("aa", F.col("position").cast("string"))
    listed = joined_list(positions.withColumn("_place", place), ["peptide_key"], "_place", "_places", sep="#")
    return listed.select("peptide_key", F.concat_ws("#", "peptide_key", "_places").alias("positions"))


def site_label(n_sites: Column, n_positions: Column, text: Column) -> Column:
    """``not found`` without a site, ``-`` without a position, ``ambiguous`` with several, else the text."""
    return (
        F.when(n_sites == 0, "not found")
        .when(F.coalesce(n_positions, F.lit(0)) == 0, "-")
        .when(n_positions > 1, "ambiguous")
        .otherwise(text)
    )


def protein_ptm_states(
    spans: DataFrame, positions: DataFrame, modified: DataFrame, max_ptms: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Modification states of proteins with up to ``max_ptms`` modified positions.

    Returns ``(states, edges)``. A state is a set of positions that is the union of the sets of some
    modified peptides. States are found as subsets of the protein's positions that equal the union
    of the peptide sets they contain, at most 2**max_ptms - 1 of them whatever the number of
    peptides. ``edges`` is the rewired ``(protein_acc, state_key, peptide_key)``: unmodified
    peptides join a state when they cover none of its positions, modified ones when they agree with
    it, and a modified peptide with a state leaves the bare protein (``state_key`` null).
    """
    if max_ptms > 30:
        raise ValueError("a state is a mask of 32 bits: at most 30 modified positions")
    # Read by nine branches below, so it is worked out once.
    marks = cut(positions.select("protein_acc", "peptide_key", "protein_position", "aa", "delta_mass").distinct(), "marks")
    places = marks.select("protein_acc", "protein_position", "aa", "delta_mass").distinct()
    few = places.groupBy("protein_acc").agg(F.count("*").alias("_n")).filter(F.col("_n") <= max_ptms).drop("_n")
    bounded = places.join(few, "protein_acc", "left_semi")
    held = bounded.groupBy("protein_acc").agg(
        F.array_sort(F.collect_list(F.struct("protein_position", "aa", "delta_mass"))).alias("_places")
    )
    # One bit per position of the protein.
    place = F.array_position("_places", F.struct("protein_position", "aa", "delta_mass")).cast("int")
    bit = F.call_function("shiftleft", F.lit(1), place - 1)
    masks = marks.join(held, "protein_acc").groupBy("protein_acc", "peptide_key").agg(F.bit_or(bit).alias("_mask"))
    sets = masks.groupBy("protein_acc").agg(F.collect_set("_mask").alias("_masks"))
    candidates = held.join(sets, "protein_acc").withColumn(
        "_state", F.explode(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("_places")) - 1))
    )
    within = F.filter("_masks", lambda m: m.bitwiseAND(F.col("_state")) == m)
    union = F.aggregate(within, F.lit(0), lambda acc, m: acc.bitwiseOR(m))
    states = candidates.filter(union == F.col("_state")).withColumn(
        "_held", F.filter("_places", lambda x, i: F.call_function("shiftright", F.col("_state"), i).bitwiseAND(F.lit(1)) == 1)
    )
    # A handful of distinct masses over all data, in order of mass.
    masses = places.agg(F.array_sort(F.collect_set("delta_mass"))).scalar()
    states = states.withColumn("_codes", masses)
    text = F.transform(
        "_held",
        lambda x: F.concat(x["aa"], x["protein_position"].cast("string"), F.lit("("), ptm_code(x["delta_mass"], F.col("_codes")), F.lit(")")),
    )
    states = cut(states.select(
        "protein_acc",
        F.concat("protein_acc", F.lit("_"), F.array_join(text, ",")).alias("state_key"),
        F.transform("_held", lambda x: x["protein_position"]).alias("state_positions"),
    ), "states")
    # Only proteins with a state meet one; the others leave before the joins.
    stated = spans.join(states.select("protein_acc").distinct(), "protein_acc", "left_semi")
    own = marks.groupBy("protein_acc", "peptide_key").agg(F.collect_set("protein_position").alias("_own"))
    flagged = stated.join(modified.select("peptide_key").distinct().withColumn("_mod", F.lit(True)), "peptide_key", "left")
    joined = flagged.join(own, ["protein_acc", "peptide_key"], "left").join(states, "protein_acc")
    start, end, state = F.col("start"), F.col("end"), F.col("state_positions")
    is_modified = F.coalesce("_mod", F.lit(False))
    fits = F.when(
        is_modified,
        (F.size(F.array_except("_own", state)) == 0) & (F.size(F.array_except(F.filter(state, lambda at: at.between(start, end)), "_own")) == 0),
    ).otherwise(~covers(start, end, state))
    # A peptide found at several places must fit at each.
    attached = (
        joined.groupBy("protein_acc", "state_key", "peptide_key")
        .agg(F.bool_and(F.coalesce(fits, F.lit(False))).alias("_fits"), F.max(is_modified).alias("_modified"))
        .filter("_fits")
    )
    moved = attached.filter("_modified").select("protein_acc", "peptide_key").distinct()
    bare = spans.select("protein_acc", "peptide_key").distinct().join(moved, ["protein_acc", "peptide_key"], "left_anti")
    rewired = attached.select("protein_acc", "state_key", "peptide_key").unionByName(
        bare.withColumn("state_key", F.lit(None).cast("string"))
    )
    return states, rewired

"""Protein pairs: nodes that share peptides, their three ratios and consistency cases."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquant.functions.ratios import INF, STAT_COLUMNS, RatioCounts, has_finite_and_inf, inf_mean, is_finite, nan
from netquant.lineage import cut
from netquant.operators.aggregates import merged_ratio
from netquant.operators.nodes import joined_list, unique_peptide_nodes
from netquant.operators.ranking import grouped_median

PAIR = ("node_1", "node_2")
# Fewest values an outlier test accepts, and its default threshold (fixed values).
MIN_VALUES_TO_TEST = 10
MODIFIED_Z_THRESHOLD = 3.5
MODIFIED_Z_SCALE = 0.6745
# A median deviation below this is rounding noise of equal ratios.
SMALLEST_DEVIATION = 1e-9


def pair_members(links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, node_1, node_2, peptide_node)``: each shared peptide node of each pair, node_1 < node_2.

    The pairs of a peptide node are the result itself. Peptide nodes of one protein node are left
    out before the join, and a hub is split on both sides by the skew join rule.
    """
    by = list(by)
    shared = links.groupBy(*by, "peptide_node").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    kept = links.join(shared, [*by, "peptide_node"], "left_semi")
    first = kept.withColumnRenamed("protein_node", "node_1")
    second = kept.withColumnRenamed("protein_node", "node_2")
    return first.join(second, [*by, "peptide_node"]).filter(F.col("node_1") < F.col("node_2"))


def similar_pairs(links: DataFrame, alignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of protein nodes whose peptide nodes hold similar peptides (``peptide_1``, ``peptide_2``)."""
    by = list(by)
    keys = [c for c in by if c in alignments.columns]
    both = alignments.select(*keys, F.col("peptide_1").alias("a"), F.col("peptide_2").alias("b"))
    one = links.select(*by, F.col("peptide_node").alias("a"), F.col("protein_node").alias("p"))
    two = links.select(*by, F.col("peptide_node").alias("b"), F.col("protein_node").alias("q"))
    return (
        both.join(one, [*keys, "a"])
        .join(two, [*by, "b"])
        .filter(F.col("p") != F.col("q"))
        .select(*by, F.least("p", "q").alias("node_1"), F.greatest("p", "q").alias("node_2"))
        .distinct()
    )


def protein_pairs(links: DataFrame, by: Sequence[str] = (), alignments: DataFrame | None = None) -> DataFrame:
    """Distinct pairs sharing a peptide node, or a similar peptide when alignments are given."""
    pairs = pair_members(links, by).select(*by, *PAIR).distinct()
    if alignments is None:
        return pairs
    return pairs.union(similar_pairs(links, alignments, by)).distinct()


def orient_pairs(pairs: DataFrame, links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, first_node, second_node)``: the node with a peptide node that the other lacks first, else the greater key first."""
    by = list(by)
    links = links.select(*by, "protein_node", "peptide_node").distinct()
    degree = links.groupBy(*by, "protein_node").agg(F.count("*").alias("_n"))
    one = degree.select(*by, F.col("protein_node").alias("node_1"), F.col("_n").alias("_n_1"))
    two = degree.select(*by, F.col("protein_node").alias("node_2"), F.col("_n").alias("_n_2"))
    shared = pair_members(links, by).groupBy(*by, *PAIR).agg(F.count("*").alias("_shared"))
    counted = pairs.join(shared, [*by, *PAIR], "left").join(one, [*by, "node_1"], "left").join(two, [*by, "node_2"], "left")
    both = F.coalesce("_shared", F.lit(0))
    has_1, has_2 = F.coalesce("_n_1", F.lit(0)) > both, F.coalesce("_n_2", F.lit(0)) > both
    keep = F.when(has_1 != has_2, has_1).otherwise(F.col("node_1") > F.col("node_2"))
    return counted.select(
        *by,
        F.when(keep, F.col("node_1")).otherwise(F.col("node_2")).alias("first_node"),
        F.when(keep, F.col("node_2")).otherwise(F.col("node_1")).alias("second_node"),
    )


def unique_nodes_of(
    pairs: DataFrame, links: DataFrame, side: str, other: str, by: Sequence[str] = (), unique_only: bool = True
) -> DataFrame:
    """``(by, pair, peptide_node)`` unique to one side: of that node alone, or merely not of the other."""
    by = list(by)
    keys = [*by, side]
    if unique_only:
        own = unique_peptide_nodes(links, by).withColumnRenamed("protein_node", side)
        return pairs.join(own, keys)
    own = pairs.join(links.withColumnRenamed("protein_node", side), keys)
    theirs = links.withColumnRenamed("protein_node", other)
    return own.join(theirs, [*by, other, "peptide_node"], "left_anti")


def shared_nodes(members: DataFrame, links: DataFrame, by: Sequence[str] = (), only_two: bool = False) -> DataFrame:
    """Shared peptide nodes of each pair; optionally those that no third protein node has."""
    if not only_two:
        return members
    two = links.groupBy(*by, "peptide_node").agg(F.count("*").alias("_n")).filter("_n = 2").drop("_n")
    return members.join(two, [*by, "peptide_node"], "left_semi")


def protein_sets(links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, peptide_node, set_id, n_sharing)``: a name for the set of protein nodes of each peptide node, and its size.

    Peptide nodes with equal sets share the name, the least of them; sets are compared by size and two 64-bit hashes.
    """
    by = list(by)
    signature = ["n_sharing", "_hash_1", "_hash_2"]
    signed = links.groupBy(*by, "peptide_node").agg(
        F.count("*").alias("n_sharing"),
        F.bit_xor(F.xxhash64(F.lit(1), "protein_node")).alias("_hash_1"),
        F.bit_xor(F.xxhash64(F.lit(2), "protein_node")).alias("_hash_2"),
    )
    named = signed.groupBy(*by, *signature).agg(F.min("peptide_node").alias("set_id"))
    return signed.join(named, [*by, *signature]).select(*by, "peptide_node", "set_id", "n_sharing")


def set_members(links: DataFrame, sets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, set_id, protein_node)``: the protein nodes of each set, once however many peptide nodes have it."""
    by = list(by)
    named = sets.filter("peptide_node = set_id").select(*by, "peptide_node")
    return links.join(named, [*by, "peptide_node"], "left_semi").select(*by, F.col("peptide_node").alias("set_id"), "protein_node")


def set_texts(links: DataFrame, sets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, set_id, protein_set)``: the set as the text of an output table."""
    return joined_list(set_members(links, sets, by), [*by, "set_id"], "protein_node", "protein_set")


def pair_sets(of_set: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, node_1, node_2, set_id)``: the sets that hold both nodes of a pair. ``of_set``: :func:`set_members`."""
    return pair_members(of_set.withColumnRenamed("set_id", "peptide_node"), by).withColumnRenamed("peptide_node", "set_id")


def shared_by_set(links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, pair, set_id, n_shared)``: shared peptide nodes of each pair, grouped by who shares them."""
    by = list(by)
    sets = cut(protein_sets(links, by), "sets")
    held = sets.groupBy(*by, "set_id").agg(F.count("*").alias("n_shared"))
    return pair_sets(set_members(links, sets, by), by).join(held, [*by, "set_id"])


def shared_by_protein(links: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, pair, protein_node, n_shared_nodes)``: every protein node holding shared nodes of the pair.

    The table itself has a row per pair and protein of a hub; operators that need only the number use :func:`n_sharing`.
    """
    by = list(by)
    sets = cut(protein_sets(links, by), "sets")
    of_set = set_members(links, sets, by)
    held = sets.groupBy(*by, "set_id").agg(F.count("*").alias("_n"))
    rows = pair_sets(of_set, by).join(of_set.join(held, [*by, "set_id"]), [*by, "set_id"])
    return rows.groupBy(*by, *PAIR, "protein_node").agg(F.sum("_n").alias("n_shared_nodes"))


def sharing_signatures(of_pair: DataFrame, sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, pair, n_sets, largest, hash_1, hash_2)``: which sets a pair lies in, combined map-side."""
    by = list(by)
    return of_pair.join(sizes, [*by, "set_id"]).groupBy(*by, *PAIR).agg(
        F.count("*").alias("n_sets"),
        F.max("n_sharing").alias("largest"),
        F.bit_xor(F.xxhash64(F.lit(3), "set_id")).alias("hash_1"),
        F.bit_xor(F.xxhash64(F.lit(4), "set_id")).alias("hash_2"),
    )


def expanded_signatures(signed: DataFrame, of_pair: DataFrame, of_set: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, signature, protein_node)``: the proteins of each combination of two sets or more, taken from one of its pairs."""
    by = list(by)
    signature = ["n_sets", "hash_1", "hash_2"]
    one = signed.filter("n_sets > 1").groupBy(*by, *signature).agg(F.min(F.struct(*PAIR)).alias("_pair"))
    named = one.select(*by, *signature, "_pair.*")
    return named.join(of_pair, [*by, *PAIR]).drop(*PAIR).join(of_set, [*by, "set_id"]).select(*by, *signature, "protein_node")


def n_sharing(of_pair: DataFrame, of_set: DataFrame, sets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, pair, n_sharing)``: protein nodes around the shared nodes of each pair; above 2 a third one explains it.

    The number of a pair in one set is that set's size. Pairs in the same several sets have the same number: only one pair of
    each combination of sets is expanded to proteins, so a hub costs its pairs and never pairs times proteins.
    """
    by = list(by)
    sizes = sets.filter("peptide_node = set_id").select(*by, "set_id", "n_sharing")
    signed = cut(sharing_signatures(of_pair, sizes, by), "pair-signatures")
    signature = ["n_sets", "hash_1", "hash_2"]
    counted = expanded_signatures(signed, of_pair, of_set, by).distinct().groupBy(*by, *signature).agg(F.count("*").alias("_n"))
    several = signed.filter("n_sets > 1").join(counted, [*by, *signature]).select(*by, *PAIR, F.col("_n").alias("n_sharing"))
    return signed.filter("n_sets = 1").select(*by, *PAIR, F.col("largest").alias("n_sharing")).union(several)


def shared_sets(links: DataFrame, stats: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(by, set_id, protein_node, n_sharing, s, u)`` of the sets of two nodes or more, and their texts ``(by, set_id, protein_set)``.

    ``s`` is the set's ratio and ``u`` the one of the node's own peptide nodes, null without any. Peptide nodes of one protein
    node need no name: they go to that node, only the others are grouped by their set (see :func:`protein_sets`).
    """
    by = list(by)
    key, signature = [*by, "peptide_node"], ["n_sharing", "_hash_1", "_hash_2"]
    signed = links.groupBy(*key).agg(
        F.count("*").alias("n_sharing"),
        F.bit_xor(F.xxhash64(F.lit(1), "protein_node")).alias("_hash_1"),
        F.bit_xor(F.xxhash64(F.lit(2), "protein_node")).alias("_hash_2"),
    )
    measured = cut(signed.join(stats, key, "left"), "set-stats")
    k = RatioCounts.read("_")
    named = measured.filter("n_sharing > 1").groupBy(*by, *signature).agg(
        F.min("peptide_node").alias("peptide_node"), *RatioCounts.merged().columns("_")
    )
    named = named.select(*key, "n_sharing", inf_mean(k).alias("s"))
    alone = measured.filter("n_sharing = 1").select(*key, *STAT_COLUMNS)
    # Said here, so that both joins read one exchange of the links.
    links = links.filter(F.col("protein_node").isNotNull())
    unique = merged_ratio(links.join(alone, key), [*by, "protein_node"], "u").drop("n_u")
    held = links.join(named, key).withColumnRenamed("peptide_node", "set_id")
    of_set = cut(held.join(unique, [*by, "protein_node"], "left").select(*by, "set_id", "protein_node", "n_sharing", "s", "u"), "set-members")
    return of_set, joined_list(of_set, [*by, "set_id"], "protein_node", "protein_set")


def paired_sets(of_set: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, node_1, node_2, set_id, n_sharing, u1, s, u2)``: :func:`pair_sets` with the values of both nodes and of the set."""
    by = list(by)
    first = of_set.withColumnsRenamed({"protein_node": "node_1", "u": "u1"})
    second = of_set.select(*by, "set_id", F.col("protein_node").alias("node_2"), F.col("u").alias("u2"))
    rows = first.join(second, [*by, "set_id"]).filter(F.col("node_1") < F.col("node_2"))
    return rows.select(*by, *PAIR, "set_id", "n_sharing", "u1", "s", "u2")


def pair_ratios(
    links: DataFrame, stats: DataFrame, by: Sequence[str] = (), unique_only: bool = True, texts: bool = False
) -> DataFrame:
    """``(by, pair, set_id, u1, s, u2, n_sharing)`` with NaN where a side has no value; one row per pair and shared set.

    Ratios are merged from the additive counts of peptide nodes. The shared ratio belongs to the set and, with ``unique_only``, the unique one
    to the node: each is computed once and carried by the set's members, so the rows of pairs come out of one join. Otherwise a side is what
    its node has and the other lacks, set by set. Rows of a pair with one set have that set's size; only pairs of several sets look for the
    nodes around them. With ``texts`` the set's text stands in place of its name.
    """
    by = list(by)
    of_set, names = shared_sets(links, stats, by)
    rows = cut(paired_sets(of_set, by), "pair-sets")
    several = cut(rows.groupBy(*by, *PAIR).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "several")
    of_pair = cut(rows.select(*by, *PAIR, "set_id", "n_sharing").join(several, [*by, *PAIR], "left_semi"), "several-sets")
    sets = of_pair.select(*by, F.col("set_id").alias("peptide_node"), "set_id", "n_sharing").distinct()
    theirs = of_set.select(*by, "set_id", "protein_node").join(sets, [*by, "set_id"], "left_semi")
    around = n_sharing(of_pair.drop("n_sharing"), theirs, sets, by).withColumnRenamed("n_sharing", "_around")
    result = rows.join(cut(around, "around"), [*by, *PAIR], "left").withColumn("n_sharing", F.coalesce("_around", "n_sharing"))
    if not unique_only:
        result = _loose_sides(result.drop("u1", "u2"), links, stats, by)
    shown = "set_id"
    if texts:
        result, shown = result.join(names, [*by, "set_id"]), "protein_set"
    return result.select(*by, *PAIR, shown, *[F.coalesce(c, nan()).alias(c) for c in ("u1", "s", "u2")], "n_sharing")


def _loose_sides(rows: DataFrame, links: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Ratios u1 and u2 of what the node of a side has and the other lacks."""
    sets = cut(protein_sets(links, by), "sets")
    nodes = cut(set_members(links, sets, by), "set-members").withColumnRenamed("set_id", "peptide_node")
    summed = sets.join(stats, [*by, "peptide_node"]).groupBy(*by, "set_id").agg(*[F.sum(c).alias(c) for c in STAT_COLUMNS])
    pairs = rows.select(*by, *PAIR).distinct()
    for side, other, out in (("node_1", "node_2", "u1"), ("node_2", "node_1", "u2")):
        own = unique_nodes_of(pairs, nodes, side, other, by, unique_only=False).withColumnRenamed("peptide_node", "set_id")
        ratio = merged_ratio(own.join(summed, [*by, "set_id"]), [*by, *PAIR], out)
        rows = rows.join(ratio.drop(f"n_{out}"), [*by, *PAIR], "left")
    return rows


def classify_fold_change(
    ratios: DataFrame, fold: float = 2.0, outlier_case: str | None = None
) -> DataFrame:
    """Fold-change case 1-6 of each pair and shared set, with the three inconsistency flags.

    ``outlier_case`` names the column of :func:`classify_outlier`; where it is not null the
    statistical test decides in place of the middle-half rule.
    """
    threshold = F.lit(math.log2(fold))
    swapped = F.col("u1") > F.col("u2")
    low, high, s = F.least("u1", "u2"), F.greatest("u1", "u2"), F.col("s")
    both_inf = (F.abs(low) == INF) & (F.abs(high) == INF)
    distance = F.when(both_inf & (low == high), F.lit(0.0)).otherwise(high - low)
    missing = F.isnan("u1") | F.isnan("s") | F.isnan("u2")
    inside = (s >= low) & (s <= high)
    differs = distance > threshold
    far = (s < low - threshold) | (s > high + threshold)
    above_low, below_high = s > low + distance / 4, s < high - distance / 4
    middle = (above_low & below_high) | (both_inf & (F.abs(distance) != INF) & (F.abs(s) != INF))

    tested = F.lit(False)
    test_case = F.lit("CASE6")
    if outlier_case is not None:
        tested = F.col(outlier_case).isNotNull()
        test_case = F.when(F.col(outlier_case).isin("CASE3", "CASE6", "CASE7"), "CASE3").otherwise("CASE6")

    case = (
        F.when(missing, "CASE6")
        .when(inside & ~differs, "CASE6")
        .when(inside & tested, test_case)
        .when(inside & middle, "CASE4")
        .when(inside, "CASE3")
        .when(far & (F.col("n_sharing") > 2), "CASE2")
        .when(far, "CASE1")
        .when(tested, test_case)
        .when(differs, "CASE3")
        .otherwise("CASE5")
    )
    by_rule = ~missing & ~tested
    both = by_rule & inside & differs & middle
    split = by_rule & inside & differs & ~middle
    outside = by_rule & ~inside & ~far & differs
    # Which of the two ordered sides disagrees with the shared ratio.
    low_bad = both | (split & (above_low | (F.abs(low) == INF))) | (outside & (s > high))
    high_bad = both | (split & (below_high | (F.abs(high) == INF))) | (outside & (s < low))
    return ratios.withColumns(
        {
            "fold_case": case,
            "unique_1_inconsistent": F.when(swapped, high_bad).otherwise(low_bad),
            "unique_2_inconsistent": F.when(swapped, low_bad).otherwise(high_bad),
            "shared_inconsistent": ~missing & ~inside & far,
        }
    )


def modified_z(
    population: DataFrame, keys: Sequence[str], tested: str = "tested", value: str = "value", source: str = "is_tested"
) -> DataFrame:
    """Iglewicz-Hoaglin score of the tested value of each group against its population.

    ``population`` holds one row per value of (keys), the tested value included and flagged.
    Returns ``(keys, n_values, modified_z)``; a zero median deviation (equal values) gives 0, no outlier.
    """
    keys = list(keys)
    center = cut(grouped_median(population, keys, value, "_median"), "medians")
    spread = population.join(center, keys).withColumn("_deviation", F.abs(F.col(value) - F.col("_median")))
    mad = grouped_median(spread, keys, "_deviation", "_mad")
    own = population.groupBy(*keys).agg(F.count("*").alias("n_values"), F.max(F.when(F.col(source), F.col(value))).alias(tested))
    score = F.when(F.col("_mad") > SMALLEST_DEVIATION, F.lit(MODIFIED_Z_SCALE) * F.abs(F.col(tested) - F.col("_median")) / F.col("_mad"))
    return (
        own.join(center, keys)
        .join(mad, keys)
        .select(*keys, "n_values", F.coalesce(score, F.lit(0.0)).alias("modified_z"))
    )


def outlier_scores(
    ratios: DataFrame, links: DataFrame, values: DataFrame, by: Sequence[str] = (), unique_only: bool = True, block: int = 20_000
) -> DataFrame:
    """``(by, pair, set_id, test, n_values, modified_z)`` of the three outlier tests of each pair and shared set with finite ratios.

    ``values`` holds one row per individual value of a peptide node; the values of a protein set are one run. u1 is tested against the shared
    run and the runs of side 2, u2 against side 1 and the shared run, the shared ratio against both sides, each with the tested value itself.
    A side's runs are those of the sets of its node that the other node is not in, with ``unique_only`` of the node alone.

    Tests go to blocks of about ``block``: small sets together, the pairs of a hub as tiles of its nodes. A run is sent once to each block that
    needs it, never to a pair; medians are selected from the two or more runs inside the block.
    """
    by = list(by)
    sets = cut(protein_sets(links, by), "sets")
    usable = ratios.filter(is_finite("u1") & is_finite("s") & is_finite("u2")).select(*by, *PAIR, "set_id", "u1", "s", "u2")
    tests = cut(usable.withColumn("test_id", F.monotonically_increasing_id()), "tests")
    bundles = max(1, -(-tests.count() // block))
    tiles = tests.groupBy(*by, "set_id").agg(F.ceil(F.sqrt(F.count("*") / F.lit(float(block)))).cast("int").alias("_tiles"))
    tile = lambda node: F.pmod(F.xxhash64(node), F.col("_tiles"))
    small = F.xxhash64(F.lit(0), F.pmod(F.xxhash64(*by, "set_id"), F.lit(bundles)))
    dealt = tests.join(tiles, [*by, "set_id"]).withColumn(
        "block", F.when(F.col("_tiles") <= 1, small).otherwise(F.xxhash64(F.lit(1), *by, "set_id", tile("node_1"), tile("node_2")))
    )
    name = lambda *c: F.xxhash64(*by, *c)
    rows = dealt.select(
        "block", F.lit(0).alias("kind"), "test_id", name("set_id").alias("a"), name("node_1").alias("b"), name("node_2").alias("c"), "u1", "s", "u2"
    )
    of_set = set_members(links, sets, by)
    if unique_only:
        of_set = of_set.join(sets.filter("n_sharing = 1").select(*by, "set_id").distinct(), [*by, "set_id"], "left_semi")
    side = lambda node: dealt.select("block", *by, F.col(node).alias("protein_node"))
    held = side("node_1").union(side("node_2")).distinct().join(of_set, [*by, "protein_node"])
    run = values.filter(is_finite("log2_ratio")).join(sets, [*by, "peptide_node"]).select(*by, "set_id", F.col("log2_ratio").alias("x"))
    wanted = held.select("block", *by, "set_id").union(dealt.select("block", *by, "set_id")).distinct()
    none = F.lit(None)
    fill = lambda *names: [none.cast("double" if n in ("u1", "s", "u2") else "long").alias(n) for n in names]
    rows = rows.union(held.select("block", F.lit(1), *fill("test_id"), name("protein_node"), name("set_id"), *fill("c", "u1", "s", "u2")))
    rows = rows.union(wanted.join(run, [*by, "set_id"]).select("block", F.lit(2), *fill("test_id"), name("set_id"), *fill("b", "c"), "x", *fill("s", "u2")))
    scored = rows.groupBy("block").applyInArrow(_block_scores, "test_id long, test string, n_values long, modified_z double")
    return tests.join(scored, "test_id").select(*by, *PAIR, "set_id", "test", "n_values", "modified_z")


def _block_scores(block: pa.Table) -> pa.Table:
    """All tests of one block; its rows are tests (0), the sets of nodes (1) and the values of sets (2)."""
    parts = [block.filter(pc.equal(block.column("kind"), k)) for k in range(3)]
    read = lambda k, c: parts[k].column(c).to_numpy()
    owner = read(2, "a")
    order = np.argsort(owner, kind="stable")
    value, owner = read(2, "u1")[order], owner[order]
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    runs = dict(zip(owner[heads].tolist(), np.split(value, heads[1:])))
    sets_of: dict[int, set[int]] = {}
    for node, of in zip(read(1, "a").tolist(), read(1, "b").tolist()):
        sets_of.setdefault(node, set()).add(of)
    nothing = np.empty(0)
    ids, names, sizes, scores = [], [], [], []
    for test, shared, one, two, u1, s, u2 in zip(*(read(0, c).tolist() for c in ("test_id", "a", "b", "c", "u1", "s", "u2"))):
        first, second = sets_of.get(one, set()), sets_of.get(two, set())
        own = [[runs[r] for r in sorted(mine - theirs) if r in runs] for mine, theirs in ((first, second), (second, first))]
        both = [runs.get(shared, nothing)]
        for name, tested, around in (("u1", u1, both + own[1]), ("s", s, own[0] + own[1]), ("u2", u2, own[0] + both)):
            population = np.concatenate([*around, [tested]])
            median = np.median(population)
            mad = np.median(np.abs(population - median))
            ids.append(test)
            names.append(name)
            sizes.append(len(population))
            scores.append(MODIFIED_Z_SCALE * abs(tested - median) / mad if mad > SMALLEST_DEVIATION else 0.0)
    columns = [pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(scores, pa.float64())]
    return pa.Table.from_arrays(columns, ["test_id", "test", "n_values", "modified_z"])


def classify_outlier(
    ratios: DataFrame, scores: DataFrame, by: Sequence[str] = (), threshold: float = MODIFIED_Z_THRESHOLD, set_key: str = "set_id"
) -> DataFrame:
    """Outlier case 0-7 of each pair and shared set; null where a test has too few values.

    ``scores`` is :func:`outlier_scores`, or :func:`modified_z` over (pair, set, test).
    """
    by = list(by)
    group = [*by, *PAIR, set_key]
    wide = scores.groupBy(*group).agg(
        F.min("n_values").alias("_n"),
        *[F.max(F.when(F.col("test") == t, F.col("modified_z"))).alias(f"_z_{t}") for t in ("u1", "s", "u2")],
    )
    three = F.array("u1", "s", "u2")
    missing = F.isnan("u1") | F.isnan("s") | F.isnan("u2")
    all_inf = (F.abs("u1") == INF) & (F.abs("s") == INF) & (F.abs("u2") == INF)
    same = (F.col("u1") == F.col("s")) & (F.col("s") == F.col("u2"))
    outlier = lambda t: F.col(f"_z_{t}") >= threshold
    case = (
        F.when(missing, "CASE5")
        .when(has_finite_and_inf(three), "CASE2")
        .when(all_inf & same, "CASE4")
        .when(all_inf, "CASE1")
        .when(F.coalesce(F.col("_n"), F.lit(0)) < MIN_VALUES_TO_TEST, F.lit(None).cast("string"))
        .when(outlier("u1") | outlier("u2"), "CASE3")
        .when(outlier("s") & (F.col("n_sharing") > 2), "CASE6")
        .when(outlier("s"), "CASE7")
        .otherwise("CASE0")
    )
    return ratios.join(wide, group, "left").withColumn("outlier_case", case).drop("_n", "_z_u1", "_z_s", "_z_u2")


def incomplete_pair_mark(fold: float = 2.0) -> Column:
    """X on outlier case 6 without a second unique ratio whose shared ratio is far from the first."""
    far = F.abs(F.col("s") - F.col("u1")) >= fold
    return F.when((F.col("outlier_case") == "CASE6") & F.isnan("u2") & far, "X").otherwise("")


def case_counts(classified: DataFrame, by: Sequence[str] = (), column: str = "fold_case") -> DataFrame:
    return classified.groupBy(*by, column).agg(F.count("*").alias("n_pairs"))


def pair_fdr(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ns / (Ns + Nu/2) in percent; Ns is case 1, Nu cases 3 and 4; NaN when both are 0."""
    counted = classified.groupBy(*by).agg(
        F.count_if(F.col("fold_case") == "CASE1").alias("n_shared_cases"),
        F.count_if(F.col("fold_case").isin("CASE3", "CASE4")).alias("n_unique_cases"),
    )
    total = F.col("n_shared_cases") + F.col("n_unique_cases") / 2
    return counted.withColumn("pair_fdr", F.coalesce(F.try_divide(F.col("n_shared_cases") * 100.0, total), nan()))


def pair_counts(pairs: DataFrame, sharing: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs and the sum of protein nodes around their shared nodes."""
    return (
        pairs.join(sharing, [*by, *PAIR], "left")
        .groupBy(*by)
        .agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum("n_sharing"), F.lit(0)).alias("n_sharing_total"))
    )

"""Components, nodes and filters on random graphs."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from netquant.operators import annotate, components, filters, nodes


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def random_edges(seed, peptides, proteins, n):
    rng = random.Random(seed)
    return sorted({(f"p{rng.randrange(peptides)}", f"A{rng.randrange(proteins)}") for _ in range(n)})


@pytest.mark.parametrize("seed, peptides, proteins, n", [(1, 60, 60, 45), (2, 40, 40, 120), (3, 300, 5, 300)])
def test_clusters_equal_union_find(spark, seed, peptides, proteins, n):
    edges = random_edges(seed, peptides, proteins, n)
    got = components.clusters(spark.createDataFrame(edges, "peptide_key string, protein_acc string"))
    groups, expected = defaultdict(set), defaultdict(set)
    for row in got.collect():
        groups[row.cluster_id].add(row.protein_acc)
    for vertex, root in union_find([("q" + p, a) for p, a in edges]).items():
        if vertex.startswith("A"):
            expected[root].add(vertex)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert all(min(members) == name for name, members in groups.items())


def test_long_path_and_hub(spark):
    path = [(f"v{i:03d}", f"v{i + 1:03d}") for i in range(120)]
    hub = [("h000", f"h{i:03d}") for i in range(1, 400)]
    df = spark.createDataFrame(path + hub, "a string, b string")
    got = Counter(r.component for r in components.connected_components(df, "a", "b").collect())
    assert got == {"v000": 121, "h000": 400}


def test_similarity_joins_clusters(spark):
    edges = spark.createDataFrame([("p1", "A"), ("p2", "B"), ("p3", "C")], "peptide_key string, protein_acc string")
    alignments = spark.createDataFrame([("p1", "p3")], "peptide_1 string, peptide_2 string")
    got = {r.protein_acc: r.cluster_id for r in components.clusters(edges, alignments=alignments).collect()}
    assert got == {"A": "A", "C": "A", "B": "B"}


def test_collapse_is_exact_and_idempotent(spark):
    edges = random_edges(5, 30, 12, 90)
    df = spark.createDataFrame(edges, "peptide_key string, protein_acc string")
    members = nodes.collapse_peptides(df)
    sets = defaultdict(set)
    for p, a in edges:
        sets[p].add(a)
    by_set = defaultdict(set)
    for p, s in sets.items():
        by_set[frozenset(s)].add(p)
    got = defaultdict(set)
    for row in members.collect():
        got[row.peptide_node].add(row.peptide_key)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, by_set.values()))
    assert nodes.collapse_conflicts(df, members, "peptide_key", "protein_acc", "peptide_node").count() == 0
    proteins = nodes.collapse_proteins(df)
    links = nodes.node_edges(df, members, proteins)
    general = nodes.node_edges(df, members, proteins, indistinguishable=False)
    assert sorted(links.collect()) == sorted(general.collect())
    again = nodes.collapse_peptides(links.select(F.col("peptide_node").alias("peptide_key"), F.col("protein_node").alias("protein_acc")))
    assert again.filter("peptide_key <> peptide_node").count() == 0


def test_runs_stay_apart(spark):
    rows = [("r1", "p1", "A"), ("r1", "p1", "B"), ("r2", "p1", "A"), ("r2", "p2", "B")]
    df = spark.createDataFrame(rows, "run_id string, peptide_key string, protein_acc string")
    got = {(r.run_id, r.protein_acc): r.cluster_id for r in components.clusters(df, ["run_id"]).collect()}
    assert got == {("r1", "A"): "A", ("r1", "B"): "A", ("r2", "A"): "A", ("r2", "B"): "B"}


def test_lists_are_whole_sorted_and_distinct(spark):
    long = spark.range(3000).select(F.lit("n1").alias("node"), F.format_string("m%04d", "id").alias("member"))
    short = spark.createDataFrame([("n2", "b"), ("n2", "a"), ("n2", "b"), ("n3", None)], "node string, member string")
    got = {r.node: r.key for r in nodes.joined_list(long.union(short), ["node"], "member", "key").collect()}
    assert got == {"n1": " ".join(f"m{i:04d}" for i in range(3000)), "n2": "a b"}


def test_filters_that_do_not_settle_are_an_error(spark):
    psm = spark.createDataFrame([("s1", "p1", "r1", 1.0, 1.0)], "psm_id string, peptide_key string, replicate string, ions double, log2_ratio double")
    edges = spark.createDataFrame([("p1", "A")], "peptide_key string, protein_acc string")
    with pytest.raises(RuntimeError):
        filters.filter_to_fixpoint(psm, edges, min_psms=2, max_rounds=1)


def test_discarded_and_kept_make_the_input(spark):
    psm = spark.createDataFrame(
        [("s1", "p1", True), ("s2", "p2", False), ("s3", "p3", False)], "psm_id string, peptide_key string, has_ptm boolean"
    )
    kept = filters.drop_modified(psm)
    log = filters.discarded([(psm.filter("has_ptm"), filters.CONTAINING_PTM, "")])
    assert kept.select("peptide_key").union(log.select("peptide_key")).count() == 3


def test_unquantified_nodes_pass_count_filters(spark):
    psm = spark.createDataFrame(
        [("s1", "p1", "r1", 1.0, float("nan")), ("s2", "p2", "r1", 1.0, 2.0), ("s3", "p3", "r1", 1.0, 1.0), ("s4", "p3", "r2", 1.0, 1.0)],
        "psm_id string, peptide_key string, replicate string, ions double, log2_ratio double",
    )
    edges = spark.createDataFrame([("p1", "A"), ("p2", "B"), ("p3", "C")], "peptide_key string, protein_acc string")
    kept, left = filters.filter_to_fixpoint(psm, edges, min_psms=2)
    assert sorted(r.peptide_key for r in left.collect()) == ["p1", "p3"]
    assert kept.count() == 3


def test_one_per_peak(spark):
    rows = [("s1", "p", "k1", 1.0), ("s2", "p", "k1", 3.0), ("s3", "p", "k1", 3.0), ("s4", "p", "k2", 0.5)]
    df = spark.createDataFrame(rows, "psm_id string, peptide_key string, peak string, score double")
    assert sorted(r.psm_id for r in filters.one_per_peak(df, ["peptide_key", "peak"]).collect()) == ["s2", "s4"]


def exchanges(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_members_of_a_signature_are_exchanged_once(spark):
    edges = spark.createDataFrame(random_edges(7, 40, 20, 120), "peptide_key string, protein_acc string")
    for members in (nodes.collapse_peptides(edges), nodes.collapse_proteins(edges)):
        plan, n = exchanges(members)
        assert n == 2 and "Join" not in plan


def test_collapse_keeps_null_members_and_drops_null_runs(spark):
    rows = [("r", "p1", "A"), ("r", None, "A"), ("r", "p2", "B"), ("r", None, "B"), (None, "p1", "A"), ("r", "p3", None)]
    edges = spark.createDataFrame(rows, "run string, peptide_key string, protein_acc string")
    got = {(r.run, r.peptide_key): r.peptide_node for r in nodes.collapse_peptides(edges, ["run"]).collect()}
    assert got == {("r", "p1"): "p1", ("r", "p2"): "p2", ("r", None): None, ("r", "p3"): "p3"}


def test_peptides_of_two_clusters_are_found_by_hash_tables(spark):
    """A planted fault: p1 and the peptide without a key lie in two clusters."""
    edges = spark.createDataFrame(
        [("r", "p1", "A"), ("r", "p1", "B"), ("r", "p2", "A"), ("r", "p3", "C"), ("r", None, "A"), ("r", None, "C"), ("q", "p1", "A")],
        "run string, peptide_key string, protein_acc string",
    )
    cluster_of = spark.createDataFrame(
        [("r", "A", "A"), ("r", "B", "B"), ("r", "C", "C"), ("q", "A", "A")], "run string, protein_acc string, cluster_id string"
    )
    found = components.duplicate_cluster_peptides(edges, cluster_of, ["run"])
    assert {tuple(r) for r in found.collect()} == {("r", "p1", "A", "B"), ("r", None, "A", "C")}
    assert spark.read.parquet(next(f for f in found.inputFiles() if "several" in f)).count() == 2


def test_clusters_move_numbers_and_not_names(spark, monkeypatch):
    """Least proteins are least numbers: null keys and similar peptides as before, no text enters an aggregate."""
    written = {}

    def kept(df, label="cut", real=components.cut):
        written.setdefault(label, dict(df.dtypes))
        return real(df, label)

    monkeypatch.setattr(components, "cut", kept)
    rows = [("r", "p1", "B"), ("r", "p1", "A"), ("r", "p2", "C"), ("r", "p3", None), ("r", None, "A"), (None, "p1", "Z"), ("r", "p4", "D"), ("q", "p1", "D")]
    edges = spark.createDataFrame(rows, "run string, peptide_key string, protein_acc string")
    alignments = spark.createDataFrame([("p2", "p4")], "peptide_1 string, peptide_2 string")
    got = {(r.run, r.protein_acc): r.cluster_id for r in components.clusters(edges, ["run"], alignments).collect()}
    assert got == {("r", "A"): "A", ("r", "B"): "A", ("r", "C"): "C", ("r", "D"): "C", ("r", None): None, ("q", "D"): "D"}
    assert written["links"] == {"u": "bigint", "v": "bigint"} and written["numbered"]["id"] == "bigint"


def test_protein_strings_in_one_pass(spark):
    """Accessions, genes and species of a node equal those listed one by one; proteins of several or no annotations stay whole."""
    links = spark.createDataFrame([("n1", "A"), ("n1", "B"), ("n2", "B"), ("n3", "C"), ("n4", "D")], "peptide_node string, protein_node string")
    members = spark.createDataFrame([("A", "A"), ("A2", "A"), ("B", "B"), ("C", "C"), (None, "D")], "protein_acc string, protein_node string")
    protein = spark.createDataFrame([("A", "g2", "x"), ("A", "g1", "x"), ("A2", "g1", None), ("B", None, "y")], "protein_acc string, gene string, taxonomy string")
    found = annotate.protein_strings(links, members, protein)
    proteins, key = nodes.node_proteins(members, links), ["peptide_node"]
    apart = annotate.accession_strings(proteins, key).join(annotate.gene_strings(proteins, protein, key), key, "left").join(annotate.species_strings(proteins, protein, key), key, "left")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, apart.collect()), key=str)
    assert {tuple(r) for r in found.collect()} == {("n1", "A A2 B", "g1,g2", "x,y"), ("n2", "B", None, "y"), ("n3", "C", None, None)}

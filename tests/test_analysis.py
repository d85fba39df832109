"""The composed analyses on the smallest tables."""

import math
import random

from pyspark.sql import functions as F

from netquant.operators import integrate, reports
from netquant.plans import analysis
from netquant.plans.tables import RUN, protein_table, psm_table

SF = "/root/testdata/sf0.001"


def test_network_run(spark):
    psm = psm_table(spark, SF).withColumn("has_ptm", F.col("charge") == 7)
    result = analysis.analyse_network(
        psm.drop("protein_acc"), psm.select(*RUN, "psm_id", "protein_acc"), protein_table(spark, SF), RUN,
        ignore_modified=True, decoys="^O99", node_filters={"min_psms": 2},
    )
    counts = {name: table.count() for name, table in result.items()}
    assert all(counts[name] > 0 for name in ("psm", "peptides", "final", "pairs", "summary", "discarded", "net_edges"))
    assert counts["final"] == counts["peptide_nodes"] == counts["net_peptide_nodes"]
    assert result["final"].filter("n_psms < 2 and not isnan(log2_ratio)").count() == 0
    assert result["psm"].filter("proteins rlike 'O99'").count() == 0


def test_site_and_group_comparison(spark):
    rng = random.Random(2)
    samples = ["a", "b", "c", "d"]
    rows = [(f"s{i}", s, rng.gauss(4.0 if i < 3 and s in "ab" else 0.0, 0.3), 0.3, 5) for i in range(40) for s in samples]
    table = spark.createDataFrame(rows, "site_key string, sample string, log2_ratio double, sd double, n_meas long")
    result = analysis.compare_sites(table, samples)
    assert result["sites"].count() == 40 and result["tests"].count() == 40 * 6
    found = {(r.sample_i, r.sample_j): r.n_disc for r in result["pair_discoveries"].collect()}
    assert found["a", "c"] >= 3 and found["a", "b"] <= 1
    members = spark.createDataFrame([("x", s, 1 if s in "ab" else 2) for s in samples], "comparison_id string, sample string, side int")
    grouped = analysis.compare_groups(table, members, samples, rounds=3)
    row = grouped.first()
    assert grouped.count() == 40 and row.n_rounds == 3


def test_final_rows_are_not_sorted_before_they_are_counted(spark):
    """Only the output table is in order; queries over its rows take them without a global sort."""
    integrated = spark.createDataFrame([("a", 1.0, 2.0, 0.5, 0.1)], "peptide_node string, x double, w double, z double, fdr double")
    names = "peptide_node string, genes string, accessions string, species string, is_unique boolean, n_peptides int, n_psms int, n_runs int, n_replicates int, log2_ratio double"
    table = spark.createDataFrame([("b", "g", "p", "s", True, 1, 1, 1, 1, 3.0), ("a", "g", "p", "s", True, 1, 1, 1, 1, 4.0)], names)
    clusters = spark.createDataFrame([("a", "c"), ("b", "c")], "peptide_key string, cluster_id string")
    rows, ordered = reports.final_rows(integrated, table, clusters), reports.final_table(integrated, table, clusters)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan(rows) and "Sort" in plan(ordered)
    assert [r.log2_ratio for r in ordered.collect()] == [1.0, 3.0] and sorted(r.log2_ratio for r in rows.collect()) == [1.0, 3.0]


def test_variance_is_the_same_from_listed_and_from_long_groups(spark, monkeypatch):
    """Groups held in one row give the variance that rows of values give, and a round over them exchanges no group."""
    rows = [("s", f"g{i % 7}", math.sin(3 * i), 1.0 + i % 3) for i in range(60)]
    data = spark.createDataFrame(rows, "scale string, g string, x double, w double")
    found = []
    for most in (1000, 8, 1):
        monkeypatch.setattr(integrate, "LISTED", most)
        found.append(integrate.common_variance(data, ["g"], ["scale"]).first()["variance"])
    assert found[0] > 0 and all(abs(v - found[0]) < 1e-9 for v in found)
    lists = spark.createDataFrame([("s", "g", [(1.0, 1.0), (3.0, 1.0)], 0.0)], "scale string, g string, _values array<struct<x: double, w: double>>, variance double")
    sums = integrate._listed_sums(lists)
    assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
    assert [sums.first()[c] for c in ("_sw", "_swx", "_swxx")] == [2.0, 4.0, 10.0]

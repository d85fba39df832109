"""Readers, writers, merging and dataset comparison on small files."""

import math

import pytest
from pyspark.sql import functions as F

from netquant.functions.texts import escaped_infinity, short_number, unescaped_number
from netquant.operators import annotate, datasets, sites
from netquant.sources import readers, writers

INF = float("inf")


def put(path, text):
    path.write_text(text)
    return str(path)


def test_psm_files(spark, tmp_path):
    path = put(tmp_path / "a.tsv", "s1\tPEPK\t2.0\t10\tA\ns1\tPEPK\t2.0\t10\tB\ns2\tTIDER\tInfinity\t5\tA\ns3\tTIDER\tNaN\t5\tA\ns4\tTIDER\t0\t5\tA\n")
    psm, proteins = readers.read_psm_tsv(spark, path)
    ratios = {r.psm_id: r.log2_ratio for r in psm.collect()}
    assert ratios["s1"] == 1.0 and ratios["s2"] == INF and math.isnan(ratios["s3"]) and ratios["s4"] == -INF
    assert sorted(tuple(r) for r in proteins.collect()) == [("s1", "A"), ("s1", "B"), ("s2", "A"), ("s3", "A"), ("s4", "A")]


def test_experiments(spark, tmp_path):
    assert readers.parse_experiments("e1[r1,r2] | e2[r3]") == {"e1": ["r1", "r2"], "e2": ["r3"]}
    with pytest.raises(ValueError):
        readers.parse_experiments("e1[r1] | e2[r1]")
    one = put(tmp_path / "one file.tsv", "s1\tPEPK\t2.0\t10\tA\n")
    two = put(tmp_path / "two.tsv", "s2\tPEPK\t4.0\t10\tA\n")
    got = readers.read_experiments(spark, {"e1": {"r1": one}, "e2": {"r2": two}}).orderBy("psm_id").collect()
    assert [(r.psm_id, r.experiment, r.replicate, r.log2_ratio) for r in got] == [("s1", "e1", "r1", 1.0), ("s2", "e2", "r2", 2.0)]
    with pytest.raises(ValueError):
        readers.read_experiments(spark, {"e1": {"r1": one}, "e2": {"r1": two}})


def test_experiments_from_folders_with_equal_file_names(spark, tmp_path):
    for at, row in enumerate(["s1\tPEPK\t2.0\t10\tA\n", "s2\tPEPK\t4.0\t10\tA\n", "s3\tPEPK\t8.0\t10\tA\n"]):
        (tmp_path / f"r{at}").mkdir()
        put(tmp_path / f"r{at}" / "psm.tsv", row)
    files = {"e1": {"r0": str(tmp_path / "r0"), "r1": str(tmp_path / "r1" / "psm.tsv")}, "e2": {"r2": str(tmp_path / "r2" / "*.tsv")}}
    got = readers.read_experiments(spark, files).orderBy("psm_id").collect()
    assert [(r.psm_id, r.experiment, r.replicate, r.log2_ratio) for r in got] == [("s1", "e1", "r0", 1.0), ("s2", "e1", "r1", 2.0), ("s3", "e2", "r2", 3.0)]


def test_one_scan_for_all_replicates(spark, tmp_path):
    files = {"e1": {}, "e2": {}}
    for at in range(12):
        folder = tmp_path / f"a b+[{at}]"
        folder.mkdir()
        put(folder / "psm 1%.tsv", f"s{at}\tPEPK\t2.0\t10\tA\n")
        files[f"e{at % 2 + 1}"][f"r{at}"] = str(folder).replace("[", "\\[").replace("]", "\\]")
    inner = tmp_path / "a b+[0]" / "own.tsv"
    put(inner, "t\tPEPK\t2.0\t10\tA\n")
    files["e2"]["own"] = str(inner).replace("[", "\\[").replace("]", "\\]")
    rows = readers.read_experiments(spark, files)
    want = [(f"s{at}", f"e{at % 2 + 1}", f"r{at}") for at in range(12)] + [("t", "e2", "own")]
    assert sorted((r.psm_id, r.experiment, r.replicate) for r in rows.collect()) == sorted(want)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    with pytest.raises(ValueError):
        readers.read_experiments(spark, {"e1": {"r1": str(inner.parent.parent / "*0*"), "r2": str(inner.parent.parent / "a b*0*")}})
    with pytest.raises(FileNotFoundError):
        readers.read_experiments(spark, {"e1": {"r1": str(tmp_path / "none*")}})
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        readers.read_experiments(spark, {"e1": {"r1": str(tmp_path / "empty"), "r2": str(tmp_path / "a b*0*")}})


def test_samples_of_one_layout_are_one_scan(spark, tmp_path):
    head = "Node key\tNum PSMs\tLog2Ratio\tRatio STDEV\n"
    for at in range(6):
        put(tmp_path / f"s{at}.txt", head + f"k{at}\t{at}\t1.5\t0.2\n" if at else "Log2Ratio\tNode key\n-2.5\tk0\n")
    put(tmp_path / "bare.txt", "1\t2\n")
    listing = lambda names: spark.createDataFrame([(n, str(tmp_path / f"{n}.txt"), n == "s3") for n in names], "sample string, path string, swap boolean")
    rows = readers.read_samples(spark, listing([f"s{at}" for at in range(6)]))
    got = {r.sample: (r.site_key, r.log2_ratio, r.n_psm) for r in rows.collect()}
    assert got == {"s0": ("k0", -2.5, 0)} | {f"s{at}": (f"k{at}", -1.5 if at == 3 else 1.5, at) for at in range(1, 6)}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    with pytest.raises(ValueError):
        readers.read_samples(spark, listing(["s1", "bare"]))
    with pytest.raises(ValueError):
        readers.read_samples(spark, listing(["s1", "s1"]))


def test_merge_keeps_quantified_rows(spark):
    quant = spark.createDataFrame([("s1", "P", 1.0)], "psm_id string, peptide_key string, log2_ratio double")
    ident = spark.createDataFrame([("s1", "P"), ("s2", "Q")], "psm_id string, peptide_key string")
    of = spark.createDataFrame([("s1", "A")], "psm_id string, protein_acc string")
    more = spark.createDataFrame([("s1", "A"), ("s1", "B"), ("s2", "C")], "psm_id string, protein_acc string")
    merged, proteins = readers.merge_identifications(quant, of, ident, more)
    got = {r.psm_id: r.log2_ratio for r in merged.collect()}
    assert got["s1"] == 1.0 and math.isnan(got["s2"]) and proteins.count() == 3


def test_fasta(spark, tmp_path):
    text = ">sp|P12345|NAME_HUMAN some protein\nPEPT\nIDEK\n>tr|custom1|X\nAAA\n>Reverse_sp|P12345|X\nKEDI\n>plain description\nGGG\n"
    got = {r.protein_acc: r.sequence for r in readers.read_fasta(spark, put(tmp_path / "a.fasta", text)).collect()}
    assert got == {"P12345": "PEPTIDEK", "custom1": "AAA", "Reverse_sp|P12345|X": "KEDI", "plain": "GGG"}


def test_node_tables_and_sample_list(spark, tmp_path):
    head = "Node key\tNum PSMs\tLog2Ratio\tRatio STDEV\tRatio Score Value\n"
    one = put(tmp_path / "one.txt", head + "k1\t3\t'Infinity\t\t0.5\nk2\t2\t1.5\t0.2\t9\n")
    folder = tmp_path / "run2"
    folder.mkdir()
    put(folder / "x_peptideNodeTable_y.txt", head + "k2\t2\t'-INF\t0.1\t9\nk3\t1\t2.0\t0.1\t9\n")
    listing = readers.read_sample_list(spark, put(tmp_path / "list.tsv", f"s1\t{one}\ns2\t{folder}\tSWAP\n"))
    got = {(r.site_key, r.sample): r for r in readers.read_samples(spark, listing).collect()}
    assert got["k1", "s1"].log2_ratio == INF and got["k1", "s1"].sd == 0.5 and got["k1", "s1"].n_meas == 0
    assert got["k2", "s1"].sd == 0.2 and got["k2", "s1"].n_psm == 2
    assert got["k2", "s2"].log2_ratio == INF and got["k3", "s2"].log2_ratio == -2.0


def test_final_tables_by_name(spark, tmp_path):
    head = "peptideNodeID\tclusterID\tgenes\tACCs\tlog2Ratio\tnormZRatio\tFDR\n"
    one = put(tmp_path / "f1.txt", head + "K1_K2\tc\tg\tA,B\t1\t0.001\t0.2\nK3\tc\tg\tC\t1\t9\t0.01\nK4\tc\tg\tD\t1\t9\t\n")
    two = put(tmp_path / "f2.txt", head + "K3_K9\tc\tg\tC,Z\t1\t9\t0.02\n")
    rows = readers.compare_datasets(spark, {"one": one, "two": two}, "peptide_node", 0.05)
    assert sorted(tuple(r) for r in rows.collect()) == [("one", "K3"), ("two", "K3"), ("two", "K9")]
    assert {r.region: r.n_keys for r in datasets.region_counts(rows, ["one", "two"]).collect()} == {"one&two": 1, "two": 1}
    assert [r.key for r in datasets.in_all(rows, ["one", "two"]).collect()] == ["K3"]
    assert [r.key for r in datasets.only_in(rows, ["one", "two"], "two").collect()] == ["K9"]


def test_group_list_takes_every_comparison(spark, tmp_path):
    groups, subset = readers.read_groups(spark, put(tmp_path / "g.tsv", "c1\tA,B#15\ts1, s2\nc2\tC\ts3\n"))
    assert sorted(tuple(r) for r in groups.collect()) == [("c1", "s1"), ("c1", "s2"), ("c2", "s3")]
    assert sorted((tuple(r) for r in subset.collect()), key=str) == [("c1", "A", None), ("c1", "B", 15), ("c2", "C", None)]
    placed = spark.createDataFrame([("k1", "A", 3), ("k2", "B", 15), ("k3", "B", 16)], "site_key string, protein_acc string, position int")
    assert sorted(r.site_key for r in sites.subset_sites(placed, subset).collect()) == ["k1", "k2"]


def test_mutation_groups(spark, tmp_path):
    mutations = readers.read_mutations(spark, put(tmp_path / "m.tsv", "G1\tt\tL1\tm\tx\t\nG1\tt\tL2\tm\tx\t\nG2\tt\tL1\tm\tx\t\nG3\tt\tL9\tm\tx\t\n"))
    codes = readers.read_cell_line_codes(spark, put(tmp_path / "c.tsv", "line\tcode\nL1\tC1\nL2\tC2\n"))
    genes = spark.createDataFrame([("G1", "A", True), ("G1", "B", False), ("G3", "X", True)], "gene string, protein_acc string, reviewed boolean")
    got = {r.gene: (r.samples, r.accession) for r in readers.groups_from_mutations(mutations, codes, genes).collect()}
    assert got == {"G1": ("C1,C2", "A"), "G2": ("C1", "-")}
    assert [r.cell_line for r in readers.unknown_cell_lines(mutations, codes).collect()] == ["L9"]


def test_number_texts(spark):
    values = [1.0, INF, -INF, float("nan"), 1.7976931348623157e308, 0.12345, -0.0001, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = df.select("i", escaped_infinity("x").alias("e"), short_number("x").alias("s"), unescaped_number(escaped_infinity("x")).alias("back")).orderBy("i").collect()
    assert [r.e for r in got][:5] == ["1.0", "'Infinity", "'-Infinity", "NaN", "'+INF"]
    assert [r.s for r in got][:4] == ["1", "Infinity", "-Infinity", "N/A"] and got[5].s == "0.123" and got[6].s == "0" and got[7].s == "N/A"
    assert got[1].back == INF and got[2].back == -INF and math.isnan(got[3].back) and got[4].back == INF


def test_xml_annotation(spark):
    df = spark.createDataFrame([("<p><k>b</k><k>a</k><k>b</k></p>",)], "x string")
    assert df.select(annotate.xml_annotation("x", "p/k/text()").alias("v")).first().v == ["a", "b"]


def test_written_tables_read_back(spark, tmp_path):
    df = spark.createDataFrame([("k1", "CASE1", 1.5), ("k2", "CASE2", 2.5)], "key string, case string, x double")
    writers.write_tsv(df, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 2
    writers.write_network(df, df, str(tmp_path / "net"))
    writers.write_parquet(df, str(tmp_path / "by"), ["case"])
    assert spark.read.parquet(str(tmp_path / "by")).filter(F.col("case") == "CASE2").first().key == "k2"


def test_batch_adds_run_ids(spark):
    df = spark.createDataFrame([("s1",)], "psm_id string")
    assert sorted(tuple(r) for r in readers.run_batch({"a": df, "b": df}).collect()) == [("s1", "a"), ("s1", "b")]

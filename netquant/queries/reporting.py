"""Filters, annotation, output tables, network tables, summaries and dataset comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from netquant.functions.ratios import log2_of_ratio, ratio_of_log2
from netquant.functions.texts import escaped_infinity, short_number, unescaped_number
from netquant.lineage import checkpoint_dir, cut
from netquant.operators import aggregates, align, annotate, components, datasets, filters, groups
from netquant.operators import network as net_tables
from netquant.operators import nodes, pairs, positions, reports, sites
from netquant.operators.ranking import running, sliced
from netquant.plans.tables import REPLICATES, RUN, network, protein_table, psm_table, read
from netquant.queries import comparison, integration, pairing, sequences
from netquant.queries.common import Registry, num, rounded, snum, sql_mean, sql_n, sql_sd, with_views
from netquant.sources import readers

QUERIES = Registry()
MODIFIED_TYPE = "PROMO"


def flagged(spark, sf_dir):
    """PSMs with ``has_ptm``: the part's type starts with PROMO."""
    parts = read(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("peptide_key"),
        F.col("p_type").startswith(MODIFIED_TYPE).alias("has_ptm"),
    )
    return psm_table(spark, sf_dir).join(parts, "peptide_key", "left").withColumn("has_ptm", F.coalesce("has_ptm", F.lit(False)))


FLAGGED = {"flagged": "SELECT psm.*, coalesce(p_type LIKE 'PROMO%', false) AS has_ptm FROM psm LEFT JOIN part ON peptide_key = 'P' || p_partkey"}


@QUERIES.add("flt2_drop_modified", with_views("psm", "SELECT run_id, psm_id, peptide_key FROM flagged WHERE NOT has_ptm", FLAGGED))
def flt2_drop_modified(spark, sf_dir):
    return filters.drop_modified(flagged(spark, sf_dir)).select(*RUN, "psm_id", "peptide_key")


@QUERIES.add("flt3_drop_orphans", with_views("psm", """SELECT DISTINCT run_id, peptide_key FROM psm WHERE EXISTS
    (SELECT 1 FROM psm e JOIN orders ON e.protein_acc = 'O' || o_orderkey WHERE o_orderstatus <> 'P' AND e.run_id = psm.run_id AND e.peptide_key = psm.peptide_key)"""))
def flt3_drop_orphans(spark, sf_dir):
    """Peptides left with a protein when orders in process are taken out of the index."""
    known = read(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(
        F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("protein_acc")
    )
    psm = psm_table(spark, sf_dir)
    edges = nodes.peptide_protein_edges(psm, by=RUN).join(known, "protein_acc", "left_semi")
    return filters.drop_orphans(psm.select(*RUN, "peptide_key").distinct(), edges, RUN)


@QUERIES.add("flt5_drop_decoys", with_views("edges", "SELECT * FROM edges WHERE NOT regexp_matches(protein_acc, '^O9')"))
def flt5_drop_decoys(spark, sf_dir):
    return filters.drop_decoys(nodes.peptide_protein_edges(psm_table(spark, sf_dir), by=RUN), "^O9")


@QUERIES.add("flt7_drop_singletons", with_views("psm", f"SELECT run_id, psm_id, {snum('log2_ratio')} AS log2_ratio FROM psm WHERE NOT singleton"))
def flt7_drop_singletons(spark, sf_dir):
    return rounded(filters.drop_singletons(psm_table(spark, sf_dir)).select(*RUN, "psm_id", "log2_ratio"), "log2_ratio")


@QUERIES.add("flt8_one_per_peak", with_views("psm", """SELECT run_id, peptide_key, charge, raw_file, psm_id FROM
    (SELECT *, row_number() OVER (PARTITION BY run_id, peptide_key, charge, raw_file ORDER BY weight DESC, psm_id) AS rn FROM psm) WHERE rn = 1"""))
def flt8_one_per_peak(spark, sf_dir):
    kept = filters.one_per_peak(psm_table(spark, sf_dir), ["peptide_key", "charge", "raw_file"], RUN, score="weight")
    return kept.select(*RUN, "peptide_key", "charge", "raw_file", "psm_id")


COUNTS = """SELECT run_id, peptide_node, sum(ions) AS n_ions, count(DISTINCT psm_id) AS n_psms, count(DISTINCT replicate) AS n_replicates,
    count(DISTINCT peptide_key) AS n_peptides, bool_or(NOT isnan(log2_ratio)) AS quantified FROM node_psm GROUP BY ALL"""


def counts(spark, sf_dir):
    net = network(spark, sf_dir)
    return filters.node_filter_counts(net.psm, net.peptide_nodes, RUN)


@QUERIES.add("flt9_min_ions", with_views("node_psm", f"SELECT * FROM ({COUNTS}) WHERE NOT quantified OR n_ions >= 60"))
def flt9_min_ions(spark, sf_dir):
    return filters.filter_nodes(counts(spark, sf_dir), min_ions=60)


@QUERIES.add("flt10_min_psms", with_views("node_psm", f"SELECT * FROM ({COUNTS}) WHERE NOT quantified OR n_psms >= 3"))
def flt10_min_psms(spark, sf_dir):
    return filters.filter_nodes(counts(spark, sf_dir), min_psms=3)


@QUERIES.add("flt11_min_replicates", with_views("node_psm", f"SELECT * FROM ({COUNTS}) WHERE NOT quantified OR n_replicates >= 2"))
def flt11_min_replicates(spark, sf_dir):
    return filters.filter_nodes(counts(spark, sf_dir), min_replicates=2)


@QUERIES.add("flt12_tagged_nodes", with_views("node_psm", f"SELECT *, quantified AND NOT (n_psms >= 2 AND n_ions >= 40) AS filtered FROM ({COUNTS})"))
def flt12_tagged_nodes(spark, sf_dir):
    return filters.filter_nodes(counts(spark, sf_dir), remove=False, min_psms=2, min_ions=40)


@QUERIES.add("flt12_cascade", with_views("node_psm edges", f"""SELECT edges.* FROM edges JOIN peptide_nodes USING (run_id, peptide_key)
    WHERE EXISTS (SELECT 1 FROM ({COUNTS}) k WHERE k.run_id = edges.run_id AND k.peptide_node = peptide_nodes.peptide_node
    AND (NOT quantified OR (n_psms >= 2 AND n_replicates >= 2)))""").replace("SELECT edges.* FROM", "SELECT edges.run_id, edges.peptide_key, edges.protein_acc FROM"))
def flt12_cascade(spark, sf_dir):
    net = network(spark, sf_dir)
    _, edges = filters.apply_node_filters(net.psm, net.edges, net.peptide_nodes, RUN, min_psms=2, min_replicates=2)
    return edges


@QUERIES.add("flt12_filter_report", with_views("node_psm", f"""SELECT run_id, count(*) AS n_nodes, count(*) FILTER (quantified AND n_ions < 40) AS removed_min_ions,
    count(*) FILTER (quantified AND n_psms < 2) AS removed_min_psms FROM ({COUNTS}) GROUP BY ALL"""))
def flt12_filter_report(spark, sf_dir):
    return filters.filter_report(counts(spark, sf_dir), RUN, min_ions=40, min_psms=2)


# Removing a peptide node leaves the protein sets of the others as they are: one round is the fixpoint.
@QUERIES.add("flt13_fixpoint", with_views("node_psm edges", f"""SELECT edges.run_id, edges.peptide_key, edges.protein_acc FROM edges JOIN peptide_nodes USING (run_id, peptide_key)
    WHERE EXISTS (SELECT 1 FROM ({COUNTS}) k WHERE k.run_id = edges.run_id AND k.peptide_node = peptide_nodes.peptide_node AND (NOT quantified OR n_psms >= 3))"""))
def flt13_fixpoint(spark, sf_dir):
    net = network(spark, sf_dir)
    slim = net.psm.select(*RUN, "psm_id", "peptide_key", "replicate", "ions", "log2_ratio")
    _, edges = filters.filter_to_fixpoint(slim, net.edges, RUN, min_psms=3)
    return edges


@QUERIES.add("flt19_user_predicate", with_views("node_psm", f"SELECT * FROM ({COUNTS}) WHERE n_ions / n_psms > 25"))
def flt19_user_predicate(spark, sf_dir):
    return filters.filter_nodes(counts(spark, sf_dir), predicate=F.col("n_ions") / F.col("n_psms") > 25)


@QUERIES.add("snk8_discarded", with_views("psm edges", """SELECT DISTINCT run_id, peptide_key, 'CONTAINING_PTM' AS reason, 'modified' AS detail FROM flagged WHERE has_ptm
    UNION ALL SELECT DISTINCT run_id, peptide_key, 'PEPTIDE_WITH_NO_PROTEIN', 'decoys only' FROM edges GROUP BY run_id, peptide_key
    HAVING count(*) FILTER (NOT regexp_matches(protein_acc, '^O9')) = 0""", FLAGGED))
def snk8_discarded(spark, sf_dir):
    psm = flagged(spark, sf_dir)
    edges = nodes.peptide_protein_edges(psm, by=RUN)
    bare = edges.join(filters.drop_decoys(edges, "^O9"), [*RUN, "peptide_key"], "left_anti")
    return filters.discarded(
        [(psm.filter("has_ptm"), filters.CONTAINING_PTM, "modified"), (bare, filters.PEPTIDE_WITH_NO_PROTEIN, "decoys only")], RUN
    )


# Sources ----------------------------------------------------------------------------------


@QUERIES.add("src3_merged_identifications", with_views("psm", f"""SELECT run_id, psm_id, peptide_key, {snum('log2_ratio')} AS log2_ratio, protein_acc FROM psm WHERE experiment <> 'N'
    UNION ALL SELECT run_id, psm_id, peptide_key, NULL, protein_acc FROM psm WHERE experiment = 'N'"""))
def src3_merged_identifications(spark, sf_dir):
    """Experiment N brought in as identifications only, beside a repeat of the others."""
    psm = psm_table(spark, sf_dir).select(*RUN, "psm_id", "peptide_key", "experiment", "log2_ratio", "protein_acc")
    quant, ident = psm.filter("experiment <> 'N'"), psm.drop("log2_ratio")
    key = [*RUN, "psm_id"]
    merged, of = readers.merge_identifications(
        quant.drop("protein_acc"), quant.select(*key, "protein_acc"), ident.drop("protein_acc"), ident.select(*key, "protein_acc"), RUN
    )
    return rounded(merged.drop("experiment").join(of, key), "log2_ratio")


def _psm_rows(spark, sf_dir):
    """Rows of a PSM file: psm, peptide, linear ratio, weight, protein; and the names that files carry."""
    zero, one = F.col("numerator") <= 0, F.col("denominator") <= 0
    ratio = F.when(zero & one, F.lit(float("nan"))).when(one, F.lit(float("inf"))).when(zero, 0.0).otherwise(F.try_divide("numerator", "denominator"))
    return psm_table(spark, sf_dir).select("psm_id", "peptide_key", ratio.alias("ratio"), "weight", "protein_acc", "experiment", "replicate")


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/netquant/{name}-{uuid.uuid4().hex}"


@QUERIES.add("src1_psm_files", with_views("psm", f"""SELECT DISTINCT psm_id, peptide_key, weight, protein_acc, {snum('log2_ratio')} AS log2_ratio FROM psm"""))
def src1_psm_files(spark, sf_dir):
    """All PSMs written as a separated-values table and read back."""
    path = _folder(spark, "psm-files")
    _psm_rows(spark, sf_dir).drop("experiment", "replicate").write.csv(path, sep="\t")
    psm, of = readers.read_psm_tsv(spark, path)
    return rounded(psm.join(of, "psm_id").select("psm_id", "peptide_key", "weight", "protein_acc", "log2_ratio"), "log2_ratio")


@QUERIES.add("src2_experiment_files", with_views("psm", f"""SELECT experiment, replicate, psm_id, peptide_key, weight, protein_acc, {snum('log2_ratio')} AS log2_ratio FROM psm"""))
def src2_experiment_files(spark, sf_dir):
    """A folder of files per replicate, read back in one scan with experiment and replicate."""
    path = _folder(spark, "experiments")
    rows = _psm_rows(spark, sf_dir)
    rows.withColumn("folder", F.col("replicate")).drop("experiment", "replicate").write.partitionBy("folder").csv(path, sep="\t")
    files: dict[str, dict[str, str]] = {}
    for name in rows.select("experiment", "replicate").distinct().collect():  # the names of the folders
        files.setdefault(name["experiment"], {})[name["replicate"]] = f"{path}/folder={name['replicate']}"
    found = readers.read_experiments(spark, files)
    return rounded(found.select("experiment", "replicate", "psm_id", "peptide_key", "weight", "protein_acc", "log2_ratio"), "log2_ratio")


@QUERIES.add("src6_sample_tables", with_views("psm", f"""SELECT site_key, sample, CAST({snum("CASE WHEN sample = 'RF' THEN -x ELSE x END")} AS DOUBLE) AS log2_ratio,
    CASE WHEN n_psm > 1 AND sample <> 'RF' THEN sd ELSE score END AS sd, CAST(n_psm AS INTEGER) AS n_psm, CAST(0 AS INTEGER) AS n_meas
    FROM (SELECT peptide_key AS site_key, replicate AS sample, max(log2_ratio) AS x, min(CAST(ions AS DOUBLE)) AS sd, max(CAST(weight AS DOUBLE)) AS score, count(*) AS n_psm
          FROM psm WHERE NOT isnan(log2_ratio) GROUP BY 1, 2)"""))
def src6_sample_tables(spark, sf_dir):
    """Node tables of all replicates in two layouts and a sample list, one label-swapped sample; read back."""
    path = _folder(spark, "samples")
    site = psm_table(spark, sf_dir).filter(~F.isnan("log2_ratio")).groupBy("peptide_key", "replicate").agg(
        F.max("log2_ratio").alias("x"), F.min(F.col("ions").cast("double")).alias("sd"), F.max(F.col("weight").cast("double")).alias("score"), F.count("*").alias("n")
    )
    head, names = readers.NODE_HEADERS, [F.col("replicate").alias("sample"), F.lit("peptideNodeTable").alias("table")]
    key, ratio = F.col("peptide_key").alias(head["site_key"]), escaped_infinity("x").alias(head["log2_ratio"])
    score, count = F.col("score").alias(head["score"]), F.col("n").alias(head["n_psm"])
    sd = F.when(F.col("n") > 1, F.col("sd")).alias(head["sd"])
    for rows, columns in ((site.filter("replicate <> 'RF'"), [key, ratio, sd, score, count]), (site.filter("replicate = 'RF'"), [count, score, ratio, key])):
        rows.select(*columns, *names).write.mode("append").partitionBy("sample", "table").csv(path, sep="\t", header=True)
    samples = site.select("replicate").distinct()
    listing = samples.select(
        "replicate", F.concat(F.lit(f"{path}/sample="), "replicate"), F.when(F.col("replicate") == "RF", "SWAP").otherwise("")
    )
    listing.write.csv(f"{path}-list", sep="\t")
    found = readers.read_samples(spark, readers.read_sample_list(spark, f"{path}-list"))
    return rounded(found.select("site_key", "sample", "log2_ratio", "sd", "n_psm", "n_meas"), "log2_ratio")


@QUERIES.add("src11_groups_from_mutations", """WITH m AS (SELECT DISTINCT c_mktsegment AS gene, 'L' || c_nationkey AS code FROM customer JOIN nation ON c_nationkey = n_nationkey),
    a AS (SELECT DISTINCT c_mktsegment AS gene, 'A' || n_regionkey AS acc, c_acctbal > 9990 AS reviewed FROM customer JOIN nation ON c_nationkey = n_nationkey),
    r AS (SELECT gene, count(*) FILTER (reviewed) AS k, max(acc) FILTER (reviewed) AS one, string_agg(DISTINCT acc, ',' ORDER BY acc) AS every FROM a GROUP BY gene)
    SELECT gene, string_agg(code, ',' ORDER BY code) AS samples, CASE WHEN k = 1 THEN one ELSE every END AS accession FROM m JOIN r USING (gene) GROUP BY gene, k, one, every""")
def src11_groups_from_mutations(spark, sf_dir):
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    mutations = joined.select(F.col("c_mktsegment").alias("gene"), F.col("n_name").alias("cell_line"))
    codes = nation.select(F.col("n_name").alias("cell_line"), F.concat(F.lit("L"), F.col("n_nationkey").cast("string")).alias("code"))
    gene_map = joined.select(
        F.col("c_mktsegment").alias("gene"), F.concat(F.lit("A"), F.col("n_regionkey").cast("string")).alias("protein_acc"),
        (F.col("c_acctbal") > 9990).alias("reviewed"),
    ).distinct()
    return readers.groups_from_mutations(mutations, codes, gene_map)


# Annotation and texts ---------------------------------------------------------------------


@QUERIES.add("ann1_annotated_nodes", with_views("protein_nodes protein", """SELECT run_id, protein_node, string_agg(DISTINCT description, '####' ORDER BY description) AS descriptions
    FROM protein_nodes JOIN protein USING (protein_acc) GROUP BY ALL"""))
def ann1_annotated_nodes(spark, sf_dir):
    net = network(spark, sf_dir)
    return annotate.description_strings(net.protein_nodes, net.protein, [*RUN, "protein_node"])


@QUERIES.add("fn3_accession_strings", with_views("links protein_nodes", """SELECT run_id, peptide_node, string_agg(DISTINCT protein_acc, ' ' ORDER BY protein_acc) AS accessions
    FROM links JOIN protein_nodes USING (run_id, protein_node) GROUP BY ALL"""))
def fn3_accession_strings(spark, sf_dir):
    net = network(spark, sf_dir)
    return annotate.accession_strings(nodes.node_proteins(net.protein_nodes, net.links, RUN), [*RUN, "peptide_node"])


@QUERIES.add("fn6_gene_strings", with_views("links protein_nodes protein", """SELECT run_id, peptide_node, string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes
    FROM links JOIN protein_nodes USING (run_id, protein_node) JOIN protein USING (protein_acc) WHERE upper(taxonomy) LIKE '%ASIA%' OR upper(taxonomy) LIKE '%EUR%' GROUP BY ALL"""))
def fn6_gene_strings(spark, sf_dir):
    net = network(spark, sf_dir)
    proteins = nodes.node_proteins(net.protein_nodes, net.links, RUN)
    return annotate.gene_strings(proteins, net.protein, [*RUN, "peptide_node"], taxa=["asia", "Eur"])


@QUERIES.add("fn6_first_gene", with_views("links protein_nodes protein", """SELECT run_id, peptide_node, min(gene) AS genes
    FROM links JOIN protein_nodes USING (run_id, protein_node) JOIN protein USING (protein_acc) GROUP BY ALL"""))
def fn6_first_gene(spark, sf_dir):
    net = network(spark, sf_dir)
    proteins = nodes.node_proteins(net.protein_nodes, net.links, RUN)
    return annotate.gene_strings(proteins, net.protein, [*RUN, "peptide_node"], first_only=True)


@QUERIES.add("fn7_species_strings", with_views("links protein_nodes protein", """SELECT run_id, peptide_node, string_agg(DISTINCT taxonomy, ',' ORDER BY taxonomy) AS species
    FROM links JOIN protein_nodes USING (run_id, protein_node) JOIN protein USING (protein_acc) WHERE taxonomy LIKE '%A%' GROUP BY ALL"""))
def fn7_species_strings(spark, sf_dir):
    net = network(spark, sf_dir)
    proteins = nodes.node_proteins(net.protein_nodes, net.links, RUN)
    return annotate.species_strings(proteins, net.protein, [*RUN, "peptide_node"], taxa=["A"])


@QUERIES.add("fn1_escaped_infinity", with_views("psm", """SELECT run_id, psm_id, CASE WHEN isnan(log2_ratio) THEN 'NaN' WHEN isinf(log2_ratio) THEN CASE WHEN log2_ratio > 0 THEN '''Infinity' ELSE '''-Infinity' END ELSE 'number' END AS kind,
    isinf(log2_ratio) AS read_back_inf FROM psm"""))
def fn1_escaped_infinity(spark, sf_dir):
    text = escaped_infinity("log2_ratio")
    rows = psm_table(spark, sf_dir).withColumn("text", text)
    return rows.select(
        *RUN, "psm_id", F.when(F.col("text").rlike("^[0-9-]"), "number").otherwise(F.col("text")).alias("kind"),
        (F.abs(unescaped_number("text")) == float("inf")).alias("read_back_inf"),
    )


@QUERIES.add("fn2_linear_ratio", with_views("psm", f"""SELECT run_id, psm_id, CASE WHEN isnan(log2_ratio) THEN NULL WHEN isinf(log2_ratio) AND log2_ratio > 0 THEN log2_ratio
    WHEN isinf(log2_ratio) THEN 0e0 ELSE round(pow(2, log2_ratio), 6) END AS ratio, {snum('log2_ratio')} AS log2_again FROM psm"""))
def fn2_linear_ratio(spark, sf_dir):
    rows = psm_table(spark, sf_dir).withColumn("ratio", ratio_of_log2("log2_ratio"))
    return rounded(rows.select(*RUN, "psm_id", "ratio", log2_of_ratio("ratio").alias("log2_again")), "ratio", "log2_again")


@QUERIES.add("fn12_short_numbers", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_quantity = round(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS quantity,
    CASE WHEN l_tax = 0 THEN '0' ELSE CAST(l_tax AS VARCHAR) END AS tax FROM lineitem""")
def fn12_short_numbers(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", short_number("l_quantity", 1).alias("quantity"), short_number("l_tax").alias("tax")
    )


@QUERIES.add("fn13_node_labels", with_views("protein_nodes protein", """SELECT run_id, protein_node, CASE WHEN length(genes) > 100 THEN 'Prot_' || protein_node ELSE genes END AS label FROM
    (SELECT run_id, protein_node, string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes FROM protein_nodes JOIN protein USING (protein_acc) GROUP BY ALL)"""))
def fn13_node_labels(spark, sf_dir):
    net = network(spark, sf_dir)
    genes = annotate.gene_strings(net.protein_nodes, net.protein, [*RUN, "protein_node"])
    return annotate.node_labels(genes, "genes").drop("genes")


@QUERIES.add("fn14_annotation_columns", with_views("protein_nodes protein", """SELECT run_id, protein_node, string_agg(DISTINCT taxonomy, ',' ORDER BY taxonomy) AS taxonomy_values,
    string_agg(DISTINCT description, ',' ORDER BY description) AS description_values FROM protein_nodes JOIN protein USING (protein_acc) GROUP BY ALL"""))
def fn14_annotation_columns(spark, sf_dir):
    net = network(spark, sf_dir)
    return annotate.annotation_columns(net.protein_nodes, net.protein, [*RUN, "protein_node"], ["taxonomy", "description"])


# Output tables ----------------------------------------------------------------------------


@QUERIES.add("snk1_psm_table", with_views("psm", """SELECT run_id, raw_file, psm_id, peptide_key AS sequence, protein_acc AS proteins, singleton,
    CASE WHEN peptide_key IN (SELECT peptide_key FROM flagged WHERE has_ptm) THEN 'FILTERED' ELSE '' END AS filtered FROM psm""", FLAGGED))
def snk1_psm_table(spark, sf_dir):
    psm = flagged(spark, sf_dir)
    return reports.psm_table(psm, psm.filter("has_ptm"), RUN).drop("log2_ratio")


@QUERIES.add("snk2_peptide_table", with_views("psm", f"""SELECT run_id, peptide_key, {snum(sql_mean('log2_ratio'))} AS log2_ratio, {sql_n('log2_ratio')} AS n_meas, {snum(sql_sd('log2_ratio'))} AS sd,
    count(DISTINCT psm_id) AS n_psms, string_agg(DISTINCT raw_file, ',' ORDER BY raw_file) AS raw_files, string_agg(DISTINCT protein_acc, ',' ORDER BY protein_acc) AS proteins FROM psm GROUP BY run_id, peptide_key"""))
def snk2_peptide_table(spark, sf_dir):
    return rounded(reports.peptide_table(psm_table(spark, sf_dir), RUN), "log2_ratio", "sd")


NODE_VIEWS = {
    "n_ratio": f"SELECT run_id, peptide_node, {sql_mean('log2_ratio')} AS log2_ratio, {sql_n('log2_ratio')} AS n_meas, {sql_sd('log2_ratio')} AS sd FROM node_psm GROUP BY ALL",
    "n_meas_counts": """SELECT run_id, peptide_node, count(DISTINCT psm_id) AS n_psms, count(DISTINCT raw_file) AS n_runs, count(DISTINCT replicate) AS n_replicates,
      count(DISTINCT peptide_key) AS n_peptides, string_agg(DISTINCT raw_file, ',' ORDER BY raw_file) AS raw_files,
      string_agg(DISTINCT peptide_key, '_' ORDER BY peptide_key) AS sequences, sum(ions) AS ion_count FROM node_psm GROUP BY ALL""",
    "n_around": """SELECT run_id, peptide_node, count(DISTINCT protein_node) AS n_connected, count(DISTINCT protein_acc) AS n_proteins,
      string_agg(DISTINCT protein_acc, ' ' ORDER BY protein_acc) AS accessions, string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes,
      string_agg(DISTINCT taxonomy, ',' ORDER BY taxonomy) AS species FROM links JOIN protein_nodes USING (run_id, protein_node) LEFT JOIN protein USING (protein_acc) GROUP BY ALL""",
}
NODE_NEEDS = "node_psm links protein_nodes protein"

_memo: dict = {}


def node_table(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _memo:
        net = network(spark, sf_dir)
        _memo[key] = cut(reports.node_rows(net.psm, net.peptide_nodes, net.links, net.protein_nodes, net.protein, RUN), "node_table")
    return _memo[key]


@QUERIES.add("snk3_node_table", with_views(NODE_NEEDS, f"""SELECT run_id, peptide_node, n_psms, n_runs, n_replicates, n_peptides, n_connected, n_proteins,
    {snum('log2_ratio')} AS log2_ratio, n_meas, {snum('sd')} AS sd, raw_files, sequences, accessions, genes, species, n_connected = 1 AS is_unique
    FROM n_ratio JOIN n_meas_counts USING (run_id, peptide_node) JOIN n_around USING (run_id, peptide_node)""", NODE_VIEWS))
def snk3_node_table(spark, sf_dir):
    return rounded(node_table(spark, sf_dir), "log2_ratio", "sd").orderBy(*RUN, "peptide_node")


def final(spark, sf_dir, table=reports.final_rows):
    net = network(spark, sf_dir)
    return table(integration.integrated(spark, sf_dir), node_table(spark, sf_dir), net.cluster_peptides, RUN)


FINAL_VIEWS = {**integration.FDR, **NODE_VIEWS, "final": """SELECT r.run_id, r.peptide_node, cluster_id, genes, accessions, species, n_connected = 1 AS is_unique, n_peptides, n_psms,
    n_runs, n_replicates, coalesce(zf.x, r.log2_ratio) AS log2_ratio, z, fdr, zf.w AS weight, n_proteins, n_connected, ion_count
    FROM n_ratio r JOIN n_meas_counts USING (run_id, peptide_node) JOIN n_around USING (run_id, peptide_node)
    JOIN cluster_peptides c ON c.run_id = r.run_id AND c.peptide_key = r.peptide_node LEFT JOIN zf ON zf.run_id = r.run_id AND zf.peptide_node = r.peptide_node"""}
FINAL_NEEDS = NODE_NEEDS + " psm peptide_nodes cluster_peptides"


@QUERIES.add("snk4_final_table", with_views(FINAL_NEEDS, f"""SELECT run_id, peptide_node, cluster_id, genes, accessions, species, is_unique, n_peptides, n_psms, n_runs, n_replicates,
    {snum('log2_ratio')} AS log2_ratio, {snum('z')} AS z, {snum('fdr')} AS fdr FROM final""", FINAL_VIEWS))
def snk4_final_table(spark, sf_dir):
    table = final(spark, sf_dir, reports.final_table).drop("ratio", "weight", "variance", "is_ion_count_ratio", "filtered")
    return rounded(table, "log2_ratio", "z", "fdr")


PAIR_VIEWS = {**pairing.RATIO_VIEWS,
    "useq": "SELECT run_id, protein_node, string_agg(peptide_node, '_' ORDER BY peptide_node) AS seqs FROM uniq GROUP BY ALL",
    "tax": "SELECT run_id, protein_node, string_agg(DISTINCT taxonomy, ',' ORDER BY taxonomy) AS tax FROM protein_nodes JOIN protein USING (protein_acc) GROUP BY ALL",
    "sseq": "SELECT run_id, node_1, node_2, protein_set, string_agg(peptide_node, '_' ORDER BY peptide_node) AS seqs FROM shared JOIN sets USING (run_id, peptide_node) GROUP BY ALL"}


@QUERIES.add("snk5_pair_table", with_views(pairing.RATIO_NEEDS + " protein_nodes protein", """SELECT c.run_id, c.node_1, c.node_2, a.seqs AS unique_1_sequences, b.seqs AS unique_2_sequences,
    x.tax AS taxon_1, y.tax AS taxon_2, s.seqs AS shared_sequences, fold_case FROM classified c JOIN sseq s USING (run_id, node_1, node_2, protein_set)
    LEFT JOIN useq a ON a.run_id = c.run_id AND a.protein_node = node_1 LEFT JOIN useq b ON b.run_id = c.run_id AND b.protein_node = node_2
    LEFT JOIN tax x ON x.run_id = c.run_id AND x.protein_node = node_1 LEFT JOIN tax y ON y.run_id = c.run_id AND y.protein_node = node_2""", PAIR_VIEWS))
def snk5_pair_table(spark, sf_dir):
    net = network(spark, sf_dir)
    classified = pairs.classify_fold_change(pairing.pair_ratio_ids(net)).withColumn("outlier_case", F.lit(None).cast("string"))
    table = reports.pair_table(classified, net.links, net.protein, net.protein_nodes, RUN)
    return table.drop("ratio_1", "ratio_2", "ratio_shared", "outlier_case", "mark")


def summary_rows(spark, sf_dir):
    return final(spark, sf_dir).withColumnRenamed("species", "taxonomy").withColumn("log2_ratio", F.coalesce("log2_ratio", F.lit(float("nan"))))


@QUERIES.add("snk6_summary", with_views(FINAL_NEEDS, f"""SELECT run_id, unnest(['peptide_nodes', 'clusters', 'positive_infinities', 'negative_infinities', 'missing_ratios', 'finite_ratios',
    'significant_nodes', 'significant_clusters', 'mean_finite_ratio', 'sd_finite_ratio', 'mean_variance']) AS metric,
    unnest([a, b, c, d, e, f, g, h, {snum('i')}, {snum('j')}, {snum('k', 4)}]) AS value FROM
    (SELECT run_id, CAST(count(*) AS DOUBLE) AS a, count(DISTINCT cluster_id) AS b, count(*) FILTER (isinf(log2_ratio) AND log2_ratio > 0) AS c,
     count(*) FILTER (isinf(log2_ratio) AND log2_ratio < 0) AS d, count(*) FILTER (isnan(log2_ratio)) AS e, count(*) FILTER (isfinite(log2_ratio)) AS f,
     count(*) FILTER (isinf(log2_ratio) OR coalesce(fdr <= 0.05, false)) AS g, count(DISTINCT CASE WHEN isinf(log2_ratio) OR fdr <= 0.05 THEN cluster_id END) AS h,
     avg(log2_ratio) FILTER (isfinite(log2_ratio)) AS i, coalesce(stddev_samp(log2_ratio) FILTER (isfinite(log2_ratio)), 0) AS j, avg(1 / weight) FILTER (weight > 0) AS k FROM final GROUP BY run_id)""", FINAL_VIEWS))
def snk6_summary(spark, sf_dir):
    table = aggregates.summary(summary_rows(spark, sf_dir), RUN)
    return table.withColumn("value", F.when(F.col("metric") == "mean_variance", num("value", 4)).otherwise(num("value")))


@QUERIES.add("agg15_infinities_by_species", with_views(FINAL_NEEDS, """SELECT run_id, species AS taxonomy, count(*) AS n_nodes, count(*) FILTER (isinf(log2_ratio) AND log2_ratio > 0) AS n_pos_inf,
    count(*) FILTER (isinf(log2_ratio) AND log2_ratio < 0) AS n_neg_inf, count(*) FILTER (isnan(log2_ratio)) AS n_missing FROM final GROUP BY run_id, species""", FINAL_VIEWS))
def agg15_infinities_by_species(spark, sf_dir):
    return aggregates.infinities_by_species(summary_rows(spark, sf_dir), RUN)


GENES = """SELECT run_id, cluster_id, string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes FROM cluster_of JOIN protein USING (protein_acc)
    WHERE upper(taxonomy) LIKE '%ASIA%' OR upper(taxonomy) LIKE '%AFRICA%' GROUP BY ALL"""
MEANS = f"""SELECT run_id, cluster_id, genes, replicate, pow(2, r) AS ratio FROM (SELECT run_id, cluster_id, replicate, {sql_mean('log2_ratio')} AS r
    FROM psm JOIN cluster_peptides USING (run_id, peptide_key) GROUP BY ALL) JOIN ({GENES}) USING (run_id, cluster_id) WHERE isfinite(r)"""


def means(spark, sf_dir):
    net = network(spark, sf_dir)
    genes = annotate.gene_strings(net.cluster_of, net.protein, [*RUN, "cluster_id"], taxa=["asia", "africa"])
    return aggregates.cluster_replicate_means(net.psm, net.cluster_peptides, genes, RUN)


@QUERIES.add("agg14_cluster_replicate_means", with_views("psm cluster_peptides cluster_of protein", f"""SELECT run_id, cluster_id, genes, replicate, {snum('ratio')} AS mean_ratio,
    {snum('1 / ratio')} AS inverse_ratio FROM ({MEANS})"""))
def agg14_cluster_replicate_means(spark, sf_dir):
    return rounded(means(spark, sf_dir), "mean_ratio", "inverse_ratio")


@QUERIES.add("snk7_replicate_matrix", with_views("psm cluster_peptides cluster_of protein", "SELECT run_id, cluster_id, genes, " + ", ".join(
    f"round(max(ratio) FILTER (replicate = '{r}'), 6) AS \"{r}\"" for r in REPLICATES) + f" FROM ({MEANS}) GROUP BY run_id, cluster_id, genes"))
def snk7_replicate_matrix(spark, sf_dir):
    wide = aggregates.pivot_replicates(means(spark, sf_dir), REPLICATES, "mean_ratio", [*RUN, "cluster_id", "genes"])
    return rounded(wide, *REPLICATES)


SAMPLE_PAIRS = [(a, b) for i, a in enumerate(REPLICATES) for b in REPLICATES[i + 1 :]]


@QUERIES.add("snk11_site_ratio_table", with_views("psm", "SELECT site_key, n_disc, " + ", ".join(
    f"""max({snum('log2_ratio')}) FILTER (sample = '{s}') AS "{s}_log2_ratio", max({snum('CASE WHEN n_meas > 1 THEN sd ELSE NULL END')}) FILTER (sample = '{s}') AS "{s}_sd", max(n_meas) FILTER (sample = '{s}') AS "{s}_n" """ for s in REPLICATES)
    + " FROM aligned JOIN per_site USING (site_key) GROUP BY site_key, n_disc", comparison.DISCOVERIES))
def snk11_site_ratio_table(spark, sf_dir):
    table = comparison.aligned(spark, sf_dir)
    tests = comparison.adjusted(spark, sf_dir)
    wide = reports.site_ratio_table(table, tests, sites.discoveries(tests), REPLICATES)
    values = [f"{s}_{c}" for s in REPLICATES for c in ("log2_ratio", "sd")]
    return rounded(wide.select("site_key", "n_disc", *values, *[f"{s}_n" for s in REPLICATES]), *values)


@QUERIES.add("snk11_site_pair_columns", with_views("psm", "SELECT site_key, " + ", ".join(
    f"""max({snum('p')}) FILTER (sample_i = '{a}' AND sample_j = '{b}') AS "{a}_vs_{b}_p", max({snum('q')}) FILTER (sample_i = '{a}' AND sample_j = '{b}') AS "{a}_vs_{b}_q" """ for a, b in SAMPLE_PAIRS)
    + " FROM adjusted GROUP BY site_key", comparison.PAIR_Q))
def snk11_site_pair_columns(spark, sf_dir):
    tests = comparison.adjusted(spark, sf_dir)
    wide = reports.site_ratio_table(comparison.aligned(spark, sf_dir), tests, sites.discoveries(tests), REPLICATES)
    columns = [f"{a}_vs_{b}_{c}" for a, b in SAMPLE_PAIRS for c in "pq"]
    return rounded(wide.select("site_key", *columns), *columns)


@QUERIES.add("snk12_total_ratio_matrix", with_views("psm", "SELECT site_key, " + ", ".join(
    f"""max({snum('log2_ratio')}) FILTER (sample = '{s}') AS "{s}" """ for s in REPLICATES) + " FROM aligned GROUP BY site_key", comparison.SITE_VIEWS))
def snk12_total_ratio_matrix(spark, sf_dir):
    return rounded(reports.total_ratio_matrix(comparison.aligned(spark, sf_dir), REPLICATES), *REPLICATES)


@QUERIES.add("snk14_group_table", with_views("psm", f"""SELECT comparison_id, site_key, {snum('p')} AS p, {snum('q')} AS q, n_significant FROM adjusted
    JOIN (SELECT comparison_id, count(*) FILTER (q < 0.05) AS n_significant FROM adjusted GROUP BY ALL) USING (comparison_id)""", comparison.GROUP_Q))
def snk14_group_table(spark, sf_dir):
    membership = groups.two_group_membership(comparison.group_rows(spark), "g1", "g2", "g1_g2")
    tests = groups.group_compare(comparison.aligned(spark, sf_dir), membership)
    table = reports.group_table(tests, groups.significant_sites(tests))
    return rounded(table.select("comparison_id", "site_key", "p", "q", "n_significant"), "p", "q")


@QUERIES.add("srt1_final_order", with_views(FINAL_NEEDS, f"""SELECT run_id, peptide_node, CAST(row_number() OVER (PARTITION BY run_id ORDER BY coalesce(round(fdr, 6), 1), peptide_node) AS INTEGER) AS place FROM final""", FINAL_VIEWS))
def srt1_final_order(spark, sf_dir):
    """The place of each node in the final order, by a distributed running count."""
    table = final(spark, sf_dir).select(*RUN, "peptide_node", F.coalesce(F.round("fdr", 6), F.lit(1.0)).alias("fdr"))
    ordered = sliced(table.withColumn("_order", F.struct("fdr", "peptide_node")), RUN, "_order")
    placed = running(ordered, RUN, "_order", F.lit(1), "sum", "place")
    return placed.select(*RUN, "peptide_node", F.col("place").cast("int").alias("place"))


# Network ----------------------------------------------------------------------------------


@QUERIES.add("net1_peptide_nodes", with_views(FINAL_NEEDS, f"""SELECT run_id, peptide_node, cluster_id, n_proteins, n_connected, ion_count,
    isinf(log2_ratio) OR coalesce(fdr <= 0.05, false) AS significant, n_proteins = 1 AS unique_peptide, n_connected = 1 AS unique_peptide_node,
    {snum("CASE WHEN isinf(log2_ratio) OR fdr <= 0.05 THEN least(greatest(log2_ratio, -10), 10) END")} AS colour_value FROM final""", FINAL_VIEWS))
def net1_peptide_nodes(spark, sf_dir):
    table = peptide_attributes(spark, sf_dir)
    return rounded(table.select(*RUN, "peptide_node", "cluster_id", "n_proteins", "n_connected", "ion_count", "significant",
                                "unique_peptide", "unique_peptide_node", "colour_value"), "colour_value")


def peptide_attributes(spark, sf_dir):
    net = network(spark, sf_dir)
    table = final(spark, sf_dir)
    around = node_table(spark, sf_dir).select(*RUN, "peptide_node", "n_connected", "n_proteins")
    ions = net.psm.join(net.peptide_nodes, [*RUN, "peptide_key"]).groupBy(*RUN, "peptide_node").agg(F.sum("ions").alias("ion_count"))
    return net_tables.peptide_node_attributes(table, around, ions, RUN)


@QUERIES.add("net2_protein_nodes", with_views(pairing.RATIO_NEEDS + " protein_nodes peptide_nodes protein", """SELECT k.run_id, k.protein_node, n_peptide_nodes, n_peptides, n_proteins,
    coalesce(u, 0) AS n_unique_nodes, coalesce(cases, '') AS cases, genes, coalesce(u, 0) > 0 AS conclusive_node, n_peptides = 1 AS conclusive_protein, true AS is_protein
    FROM (SELECT run_id, protein_node, count(DISTINCT peptide_node) AS n_peptide_nodes, count(DISTINCT peptide_key) AS n_peptides FROM links JOIN peptide_nodes USING (run_id, peptide_node) GROUP BY ALL) k
    JOIN (SELECT run_id, protein_node, count(*) AS n_proteins FROM protein_nodes GROUP BY ALL) USING (run_id, protein_node)
    LEFT JOIN (SELECT run_id, protein_node, count(*) AS u FROM uniq GROUP BY ALL) USING (run_id, protein_node)
    LEFT JOIN (SELECT run_id, protein_node, string_agg(DISTINCT fold_case, ',' ORDER BY fold_case) AS cases FROM
      (SELECT run_id, node_1 AS protein_node, fold_case FROM classified UNION ALL SELECT run_id, node_2, fold_case FROM classified) GROUP BY ALL) USING (run_id, protein_node)
    LEFT JOIN (SELECT run_id, protein_node, string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes FROM protein_nodes JOIN protein USING (protein_acc) GROUP BY ALL) USING (run_id, protein_node)""", pairing.RATIO_VIEWS))
def net2_protein_nodes(spark, sf_dir):
    net = network(spark, sf_dir)
    classified = pairs.classify_fold_change(pairing.pair_ratio_ids(net))
    genes = annotate.gene_strings(net.protein_nodes, net.protein, [*RUN, "protein_node"])
    return net_tables.protein_node_attributes(net.links, net.protein_nodes, net.peptide_nodes, classified, genes, RUN)


@QUERIES.add("net3_edges", with_views("links node_psm", f"""SELECT run_id, peptide_node AS source, protein_node AS target, CASE WHEN count(*) OVER (PARTITION BY run_id, peptide_node) = 1 THEN 'unique' ELSE 'shared' END AS kind,
    {snum('r')} AS edge_ratio FROM links JOIN (SELECT run_id, peptide_node, {sql_mean('log2_ratio')} AS r FROM node_psm GROUP BY ALL) USING (run_id, peptide_node)"""))
def net3_edges(spark, sf_dir):
    net = network(spark, sf_dir)
    return rounded(net_tables.edge_table(net.links, aggregates.node_ratio(net.psm, net.peptide_nodes, RUN), RUN), "edge_ratio")


@QUERIES.add("net4_significant_clusters", with_views(FINAL_NEEDS, """SELECT run_id, cluster_id, count(*) AS n_nodes FROM final
    WHERE (run_id, cluster_id) IN (SELECT (run_id, cluster_id) FROM final WHERE isinf(log2_ratio) OR fdr <= 0.05) GROUP BY ALL""", FINAL_VIEWS))
def net4_significant_clusters(spark, sf_dir):
    kept = net_tables.significant_clusters(peptide_attributes(spark, sf_dir), RUN)
    return kept.groupBy(*RUN, "cluster_id").agg(F.count("*").alias("n_nodes"))


@QUERIES.add("net5_clusters_by_case", with_views(pairing.RATIO_NEEDS + " cluster_of", """SELECT DISTINCT c.run_id, fold_case AS "case", cluster_id FROM classified c
    JOIN cluster_of k ON k.run_id = c.run_id AND k.protein_acc = node_1 WHERE fold_case <> 'CASE6'""", pairing.RATIO_VIEWS))
def net5_clusters_by_case(spark, sf_dir):
    net = network(spark, sf_dir)
    return net_tables.clusters_by_case(pairs.classify_fold_change(pairing.pair_ratio_ids(net)), net.cluster_of, RUN)


@QUERIES.add("net6_colour_values", with_views("psm", f"""SELECT run_id, peptide_key, {snum("CASE WHEN isfinite(r) AND abs(r) >= 0.9 OR isinf(r) THEN least(greatest(r, -2), 2) ELSE 0e0 END")} AS colour_value FROM
    (SELECT run_id, peptide_key, {sql_mean('log2_ratio')} AS r FROM psm GROUP BY ALL) WHERE NOT isnan(r)"""))
def net6_colour_values(spark, sf_dir):
    rows = aggregates.peptide_ratio(psm_table(spark, sf_dir), RUN).filter(~F.isnan("log2_ratio"))
    coloured = net_tables.colour_values(rows.withColumn("significant", F.abs("log2_ratio") >= 0.9), low=-2, high=2, flat=0.0)
    return rounded(coloured.select(*RUN, "peptide_key", "colour_value"), "colour_value")


# Datasets and subsets ---------------------------------------------------------------------


def dataset_rows(spark, sf_dir):
    """Each sample as a dataset: the sites that differ from a later sample with p at most 0.2."""
    tests = sites.pairwise_tests(comparison.aligned(spark, sf_dir))
    table = tests.select(F.col("sample_i").alias("dataset"), F.col("site_key").alias("key"), F.round("p", 9).alias("fdr"))
    return datasets.within_fdr(table, 0.2)


DATASETS = {**comparison.PAIR_TESTS, "ds": "SELECT DISTINCT sample_i AS dataset, site_key AS key FROM tests WHERE round(p, 9) <= 0.2"}
NAMES = list(REPLICATES[:-1])


@QUERIES.add("set1_regions", with_views("psm", "SELECT key, string_agg(DISTINCT dataset, '&' ORDER BY dataset) AS region FROM ds GROUP BY key", DATASETS))
def set1_regions(spark, sf_dir):
    return datasets.regions(dataset_rows(spark, sf_dir), NAMES)


@QUERIES.add("set1_region_counts", with_views("psm", "SELECT region, count(*) AS n_keys FROM (SELECT key, string_agg(DISTINCT dataset, '&' ORDER BY dataset) AS region FROM ds GROUP BY key) GROUP BY ALL", DATASETS))
def set1_region_counts(spark, sf_dir):
    return datasets.region_counts(dataset_rows(spark, sf_dir), NAMES)


@QUERIES.add("set1_element_regions", with_views("peptide_nodes psm", """SELECT dataset, node_key AS element, string_agg(DISTINCT o, '&' ORDER BY o) AS region FROM
    (SELECT a.dataset, a.node_key, b.dataset AS o FROM el a JOIN el b USING (peptide_key)) GROUP BY ALL""", {
    "el": """SELECT DISTINCT right(n.run_id, 2) AS dataset, n.peptide_key, k.node_key FROM peptide_nodes n JOIN
      (SELECT run_id, peptide_node, string_agg(peptide_key, '_' ORDER BY peptide_key) AS node_key FROM peptide_nodes GROUP BY ALL) k USING (run_id, peptide_node)"""}))
def set1_element_regions(spark, sf_dir):
    """Peptide nodes of the first and the second half-years compared by any shared peptide."""
    net = network(spark, sf_dir)
    keyed = nodes.node_keys(net.peptide_nodes, "peptide_key", "peptide_node", RUN, sep="_")
    rows = keyed.select(F.right("run_id", F.lit(2)).alias("dataset"), F.col("node_key").alias("key")).distinct()
    return datasets.element_regions(rows, ["H1", "H2"], "peptide_node")


@QUERIES.add("flt16_subset_sites", sequences.seq_sql("""SELECT DISTINCT peptide_key, protein_acc, CAST(protein_position AS INTEGER) AS position FROM sitepos s
    WHERE protein_acc IN (SELECT 'D' || doc_id FROM labels WHERE toxic = 1)
    OR EXISTS (SELECT 1 FROM labels l WHERE 'D' || l.doc_id = s.protein_acc AND toxic = 0 AND quality = 1 AND s.protein_position = 100 + l.quality)"""))
def flt16_subset_sites(spark, sf_dir):
    """Sites of the proteins labelled toxic, and one position of the good ones."""
    found = positions.site_positions(sequences.spans(spark, sf_dir), "K").select(
        "peptide_key", "protein_acc", F.col("protein_position").alias("position")
    ).distinct()
    acc = F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("protein_acc")
    place = F.when(F.col("toxic") == 1, F.lit(None).cast("int")).otherwise((F.lit(100) + F.col("quality")).cast("int")).alias("position")
    labels = read(spark, sf_dir, "labels").filter("toxic = 1 OR quality = 1")
    return sites.subset_sites(found, labels.select(acc, place))


# Measurements of document sites: a benchmark of lengths stands for the ratio of each peptide position.
@QUERIES.add("agg5_site_ratio", sequences.seq_sql(f"""SELECT site_key, {snum(sql_mean('r'))} AS log2_ratio, {sql_n('r')} AS n_meas FROM keyed JOIN
    (SELECT peptide_key, position, protein_acc, log2(CAST(n_chars AS DOUBLE) / 2000) AS r FROM (SELECT DISTINCT peptide_key, position, protein_acc FROM sitepos) JOIN documents ON protein_acc = 'D' || doc_id) USING (peptide_key, position) GROUP BY site_key""", sequences.SITE_NODES))
def agg5_site_ratio(spark, sf_dir):
    placed = positions.site_positions(sequences.spans(spark, sf_dir), "K")
    site_nodes = positions.collapse_by_site(placed)
    size = read(spark, sf_dir, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("protein_acc"), F.log2(F.col("n_chars") / 2000).alias("log2_ratio")
    )
    measured = placed.select("peptide_key", "position", "protein_acc").distinct().join(size, "protein_acc")
    return rounded(aggregates.site_ratio(site_nodes, measured).drop("sd"), "log2_ratio")


# Alignment: SQL has no affine-gap alignment; tests check it against brute force.


def alignments(spark, sf_dir):
    return sequences._kept("alignments", spark, sf_dir, lambda: align.align_peptides(sequences.edges(spark, sf_dir)))


@QUERIES.add("aln1_alignments")
def aln1_alignments(spark, sf_dir):
    return rounded(alignments(spark, sf_dir), "identity")


@QUERIES.add("gr2_similarity_clusters")
def gr2_similarity_clusters(spark, sf_dir):
    return components.clusters(sequences.edges(spark, sf_dir), alignments=alignments(spark, sf_dir))


@QUERIES.add("gr14_similar_pairs")
def gr14_similar_pairs(spark, sf_dir):
    links = sequences.edges(spark, sf_dir).withColumnsRenamed({"peptide_key": "peptide_node", "protein_acc": "protein_node"})
    return pairs.similar_pairs(links, alignments(spark, sf_dir))


@QUERIES.add("snk10_alignment_report")
def snk10_alignment_report(spark, sf_dir):
    size = F.avg("n_chars").alias("mean_size")
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("protein_acc"), "n_chars")
    ratios = sequences.edges(spark, sf_dir).join(docs, "protein_acc").groupBy("peptide_key").agg(size)
    report = align.alignment_report(alignments(spark, sf_dir), ratios.select("peptide_key", F.log2(F.col("mean_size") / 2000).alias("log2_ratio")))
    return rounded(report, "ratio_1", "ratio_2", "identity")

"""Clusters, nodes, filters, ratios and counts on the order-part network."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquant.functions.ratios import inf_count, inf_mean, inf_stddev
from netquant.operators import aggregates, components, nodes
from netquant.plans.tables import RUN, network, psm_table, read
from netquant.queries.common import Registry, rounded, snum, sql_counts, sql_mean, sql_n, sql_sd, with_views

QUERIES = Registry()


@QUERIES.add(
    "cluster_overview",
    with_views(
        "cluster_peptides node_psm protein_nodes",
        f"""SELECT run_id, cluster_id, n_peptide_nodes, n_protein_nodes, n_psms, {snum('mean_ratio')} AS mean_log2_ratio FROM
    (SELECT run_id, cluster_id, count(DISTINCT peptide_node) AS n_peptide_nodes, count(*) AS n_psms,
            {sql_mean('log2_ratio')} AS mean_ratio
     FROM node_psm JOIN cluster_peptides USING (run_id, peptide_key) GROUP BY run_id, cluster_id)
    JOIN (SELECT run_id, cluster_id, count(DISTINCT protein_node) AS n_protein_nodes
          FROM cluster_of JOIN protein_nodes USING (run_id, protein_acc) GROUP BY run_id, cluster_id)
    USING (run_id, cluster_id)""",
    ),
)
def cluster_overview(spark, sf_dir, fresh=False):
    net = network(spark, sf_dir, fresh)
    per_peptide = net.psm.groupBy(*RUN, "peptide_key").agg(*aggregates.ratio_stats("log2_ratio"))
    tagged = per_peptide.join(net.cluster_peptides, [*RUN, "peptide_key"]).join(net.peptide_nodes, [*RUN, "peptide_key"])
    key = [*RUN, "cluster_id"]
    ratios = aggregates.merged_ratio(tagged, key, "mean_log2_ratio").drop("n_mean_log2_ratio")
    counts = tagged.groupBy(*key).agg(
        F.count_if(F.col("peptide_key") == F.col("peptide_node")).alias("n_peptide_nodes"),
        F.sum("n_values").alias("n_psms"),
    )
    sizes = (
        net.cluster_of.join(net.protein_nodes, [*RUN, "protein_acc"])
        .groupBy(*key)
        .agg(F.count_if(F.col("protein_acc") == F.col("protein_node")).alias("n_protein_nodes"))
    )
    return rounded(counts.join(ratios, key).join(sizes, key), "mean_log2_ratio")


@QUERIES.add("agg1_inf_mean", with_views("psm", f"""SELECT run_id, peptide_key, replicate,
    {snum(sql_mean('log2_ratio'))} AS log2_ratio, {sql_n('log2_ratio')} AS n_meas FROM psm GROUP BY ALL"""))
def agg1_inf_mean(spark, sf_dir):
    df = psm_table(spark, sf_dir).groupBy(*RUN, "peptide_key", "replicate").agg(
        inf_mean("log2_ratio").alias("log2_ratio"), inf_count("log2_ratio").alias("n_meas")
    )
    return rounded(df, "log2_ratio")


@QUERIES.add("agg1_inf_mean_no_majority", with_views("psm", """SELECT run_id, peptide_key,
    CASE WHEN p = n THEN CAST('Infinity' AS DOUBLE) WHEN g = n THEN CAST('-Infinity' AS DOUBLE) WHEN z = n THEN NULL
    ELSE round(m, 6) + CAST(0 AS DOUBLE) END AS log2_ratio,
    CASE WHEN n IN (p, g, z) THEN n ELSE f END AS n_meas
    FROM (SELECT run_id, peptide_key, """ + ", ".join(f"{text} AS {name}" for name, text in sql_counts("log2_ratio").items())
    + " FROM psm GROUP BY ALL)", ).replace("WHEN z = n THEN NULL\n    ELSE", "WHEN z = n OR isnan(m) THEN NULL\n    ELSE"))
def agg1_inf_mean_no_majority(spark, sf_dir):
    df = psm_table(spark, sf_dir).groupBy(*RUN, "peptide_key").agg(
        inf_mean("log2_ratio", majority=False).alias("log2_ratio"),
        inf_count("log2_ratio", majority=False).alias("n_meas"),
    )
    return rounded(df, "log2_ratio")


@QUERIES.add("agg2_inf_stddev", with_views("psm", f"""SELECT run_id, peptide_key, {snum(sql_sd('log2_ratio'))} AS sd
    FROM psm GROUP BY ALL"""))
def agg2_inf_stddev(spark, sf_dir):
    df = psm_table(spark, sf_dir).groupBy(*RUN, "peptide_key").agg(inf_stddev("log2_ratio").alias("sd"))
    return rounded(df, "sd")


@QUERIES.add("agg3_peptide_ratio", with_views("psm", f"""SELECT run_id, peptide_key, {snum(sql_mean('log2_ratio'))} AS log2_ratio,
    {sql_n('log2_ratio')} AS n_meas, {snum(sql_sd('log2_ratio'))} AS sd FROM psm GROUP BY ALL"""))
def agg3_peptide_ratio(spark, sf_dir):
    return rounded(aggregates.peptide_ratio(psm_table(spark, sf_dir), RUN), "log2_ratio", "sd")


@QUERIES.add("agg4_node_ratio", with_views("node_psm", f"""SELECT run_id, peptide_node, {snum(sql_mean('log2_ratio'))} AS log2_ratio,
    {sql_n('log2_ratio')} AS n_meas, {snum(sql_sd('log2_ratio'))} AS sd FROM node_psm GROUP BY ALL"""))
def agg4_node_ratio(spark, sf_dir):
    net = network(spark, sf_dir)
    return rounded(aggregates.node_ratio(net.psm, net.peptide_nodes, RUN), "log2_ratio", "sd")


@QUERIES.add("agg4_node_replicate_ratio", with_views("node_psm", f"""SELECT run_id, peptide_node, replicate,
    {snum(sql_mean('log2_ratio'))} AS log2_ratio, {sql_n('log2_ratio')} AS n_meas, {snum(sql_sd('log2_ratio'))} AS sd
    FROM node_psm GROUP BY ALL"""))
def agg4_node_replicate_ratio(spark, sf_dir):
    net = network(spark, sf_dir)
    return rounded(aggregates.node_replicate_ratio(net.psm, net.peptide_nodes, RUN), "log2_ratio", "sd")


@QUERIES.add("agg6_intensity_ratio", with_views("node_psm links", f"""SELECT run_id, protein_node, {snum('avg(r)')} AS ri FROM
    (SELECT run_id, peptide_node, avg(log2_ratio) FILTER (isfinite(log2_ratio)) AS r FROM node_psm GROUP BY ALL)
    JOIN links USING (run_id, peptide_node) GROUP BY run_id, protein_node"""))
def agg6_intensity_ratio(spark, sf_dir):
    net = network(spark, sf_dir)
    groups = net.peptide_nodes.join(net.links, [*RUN, "peptide_node"])
    per_node = aggregates.ri_ratio(net.psm, net.peptide_nodes, ["peptide_node"], RUN)
    merged = per_node.join(groups.select(*RUN, "peptide_node", "protein_node").distinct(), [*RUN, "peptide_node"])
    return rounded(merged.groupBy(*RUN, "protein_node").agg(aggregates.finite_mean("ri").alias("ri")), "ri")


@QUERIES.add("agg7_ion_count_ratio", with_views("node_psm", f"""SELECT run_id, peptide_node, replicate, a AS ions_1, b AS ions_2,
    {snum("CASE WHEN a > 0 AND b > 0 THEN log2(a / b) WHEN a > 0 THEN CAST('Infinity' AS DOUBLE) WHEN b > 0 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST('NaN' AS DOUBLE) END")} AS rc
    FROM (SELECT run_id, peptide_node, replicate, sum(CASE WHEN numerator > 0 THEN ions ELSE 0 END) AS a,
          sum(CASE WHEN denominator > 0 THEN ions ELSE 0 END) AS b FROM node_psm GROUP BY ALL)"""))
def agg7_ion_count_ratio(spark, sf_dir):
    net = network(spark, sf_dir)
    psm = net.psm.withColumns(
        {
            "ions_1": F.when(F.col("numerator") > 0, F.col("ions")).otherwise(0.0),
            "ions_2": F.when(F.col("denominator") > 0, F.col("ions")).otherwise(0.0),
        }
    )
    return rounded(aggregates.rc_ratio(psm, net.peptide_nodes, RUN, per_replicate=True), "rc")


@QUERIES.add("agg9_individual_values", with_views("psm peptide_nodes", f"""SELECT run_id, peptide_key, peptide_node, {snum('r')} AS log2_ratio
    FROM (SELECT run_id, peptide_key, {sql_mean('log2_ratio')} AS r FROM psm GROUP BY ALL) JOIN peptide_nodes USING (run_id, peptide_key)"""))
def agg9_individual_values(spark, sf_dir):
    net = network(spark, sf_dir)
    return rounded(aggregates.individual_values(net.psm, net.peptide_nodes, RUN), "log2_ratio")


@QUERIES.add("agg16_node_counts", with_views("node_psm links protein_nodes", """SELECT run_id, peptide_node, n_psms, n_runs, n_replicates, n_peptides,
    n_connected, n_proteins FROM
    (SELECT run_id, peptide_node, count(DISTINCT psm_id) AS n_psms, count(DISTINCT raw_file) AS n_runs,
     count(DISTINCT replicate) AS n_replicates, count(DISTINCT peptide_key) AS n_peptides FROM node_psm GROUP BY ALL)
    JOIN (SELECT run_id, peptide_node, count(DISTINCT protein_node) AS n_connected, count(DISTINCT protein_acc) AS n_proteins
     FROM links JOIN protein_nodes USING (run_id, protein_node) GROUP BY ALL) USING (run_id, peptide_node)"""))
def agg16_node_counts(spark, sf_dir):
    net = network(spark, sf_dir)
    counts = aggregates.node_counts(net.psm, net.peptide_nodes, net.links, net.protein_nodes, RUN)
    return counts.drop("raw_files", "log2_ratio", "n_meas", "sd")


@QUERIES.add("fn2_log2_ratio", with_views("psm", f"SELECT run_id, psm_id, singleton, {snum('log2_ratio')} AS log2_ratio FROM psm"))
def fn2_log2_ratio(spark, sf_dir):
    return rounded(psm_table(spark, sf_dir).select(*RUN, "psm_id", "singleton", "log2_ratio"), "log2_ratio")


# Graph ------------------------------------------------------------------------------------

VERTICES_SQL = with_views("cluster_of cluster_peptides", """SELECT run_id, protein_acc AS vertex, 'protein' AS kind, cluster_id FROM cluster_of
    UNION ALL SELECT run_id, peptide_key, 'peptide', cluster_id FROM cluster_peptides""")


@QUERIES.add("gr1_clusters", VERTICES_SQL)
def gr1_clusters(spark, sf_dir):
    net = network(spark, sf_dir)
    return components.cluster_vertices(net.edges, net.cluster_of, RUN)


@QUERIES.add("gr1_clusters_one_run", """WITH RECURSIVE edges AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
    e AS (SELECT 'C' || a AS v, 'S' || b AS w FROM edges UNION SELECT 'S' || b, 'C' || a FROM edges),
    reach AS (SELECT v, v AS w FROM e UNION SELECT r.v, e.w FROM reach r JOIN e ON r.w = e.v)
    SELECT v AS vertex, min(w) AS component FROM reach GROUP BY v""")
def gr1_clusters_one_run(spark, sf_dir):
    """Trade between nations: one dense graph that forms a single component."""
    item = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    links = (
        item.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("buyer"),
            F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("seller"),
        )
        .distinct()
    )
    return components.connected_components(links, "buyer", "seller")


@QUERIES.add("gr3_protein_nodes", with_views("protein_nodes", """SELECT *, string_agg(protein_acc, ' ' ORDER BY protein_acc)
    OVER (PARTITION BY run_id, protein_node ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS node_key FROM protein_nodes"""))
def gr3_protein_nodes(spark, sf_dir):
    net = network(spark, sf_dir)
    keys = nodes.node_keys(net.protein_nodes, "protein_acc", "protein_node", RUN)
    return net.protein_nodes.join(keys, [*RUN, "protein_node"])


@QUERIES.add("gr4_peptide_nodes", with_views("peptide_nodes", """SELECT *, string_agg(peptide_key, ' ' ORDER BY peptide_key)
    OVER (PARTITION BY run_id, peptide_node ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS node_key FROM peptide_nodes"""))
def gr4_peptide_nodes(spark, sf_dir):
    net = network(spark, sf_dir)
    keys = nodes.node_keys(net.peptide_nodes, "peptide_key", "peptide_node", RUN)
    return net.peptide_nodes.join(keys, [*RUN, "peptide_node"])


@QUERIES.add("gr4_peptide_nodes_off", with_views("edges", "SELECT DISTINCT run_id, peptide_key, peptide_key AS peptide_node FROM edges"))
def gr4_peptide_nodes_off(spark, sf_dir):
    return nodes.collapse_peptides(network(spark, sf_dir).edges, RUN, on=False)


@QUERIES.add("gr8_node_edges", with_views("links", """SELECT *, count(*) OVER (PARTITION BY run_id, peptide_node) AS n_connected,
    count(*) OVER (PARTITION BY run_id, peptide_node) = 1 AS is_unique FROM links"""))
def gr8_node_edges(spark, sf_dir):
    net = network(spark, sf_dir)
    degrees = nodes.node_degrees(net.links, "peptide_node", RUN)
    return net.links.join(degrees, [*RUN, "peptide_node"]).withColumn("is_unique", F.col("n_connected") == 1)


@QUERIES.add("gr9_unique_peptide_nodes", with_views("uniq", "SELECT * FROM uniq"))
def gr9_unique_peptide_nodes(spark, sf_dir):
    return nodes.unique_peptide_nodes(network(spark, sf_dir).links, RUN)


@QUERIES.add("gr17_node_proteins", with_views("links protein_nodes", """SELECT DISTINCT run_id, peptide_node, protein_acc
    FROM links JOIN protein_nodes USING (run_id, protein_node)"""))
def gr17_node_proteins(spark, sf_dir):
    net = network(spark, sf_dir)
    return nodes.node_proteins(net.protein_nodes, net.links, RUN)


@QUERIES.add("gr18_cluster_peptides", with_views("cluster_peptides", "SELECT * FROM cluster_peptides"))
def gr18_cluster_peptides(spark, sf_dir):
    return network(spark, sf_dir).cluster_peptides


@QUERIES.add("gr18_duplicate_check", with_views("edges cluster_of", """SELECT run_id, peptide_key, min(cluster_id) AS first_cluster,
    max(cluster_id) AS last_cluster FROM edges JOIN cluster_of USING (run_id, protein_acc) GROUP BY ALL
    HAVING min(cluster_id) <> max(cluster_id)"""))
def gr18_duplicate_check(spark, sf_dir):
    net = network(spark, sf_dir)
    return components.duplicate_cluster_peptides(net.edges, net.cluster_of, RUN)


@QUERIES.add("gr19_cluster_sizes", with_views("cluster_of protein_nodes cluster_peptides", """SELECT * FROM
    (SELECT run_id, cluster_id, count(DISTINCT protein_acc) AS n_proteins, count(DISTINCT protein_node) AS n_protein_nodes
     FROM cluster_of JOIN protein_nodes USING (run_id, protein_acc) GROUP BY ALL)
    JOIN (SELECT run_id, cluster_id, count(*) AS n_peptides FROM cluster_peptides GROUP BY ALL) USING (run_id, cluster_id)"""))
def gr19_cluster_sizes(spark, sf_dir):
    net = network(spark, sf_dir)
    return nodes.cluster_sizes(net.cluster_of, net.protein_nodes, net.edges, RUN)


@QUERIES.add("gr19_single_clusters", with_views("cluster_of protein_nodes", """SELECT run_id, count(*) AS n_clusters,
    count(*) FILTER (a = 1) AS n_one_protein, count(*) FILTER (b = 1) AS n_one_protein_node, count(*) FILTER (b > 1) AS n_many_protein_nodes
    FROM (SELECT run_id, cluster_id, count(DISTINCT protein_acc) AS a, count(DISTINCT protein_node) AS b
          FROM cluster_of JOIN protein_nodes USING (run_id, protein_acc) GROUP BY ALL) GROUP BY run_id"""))
def gr19_single_clusters(spark, sf_dir):
    net = network(spark, sf_dir)
    return nodes.single_cluster_counts(nodes.cluster_sizes(net.cluster_of, net.protein_nodes, net.edges, RUN), RUN)

"""Protein pairs, their ratios and cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquant.functions.ratios import all_inf, has_finite_and_inf, only_finite, same_infinity
from netquant.lineage import cut
from netquant.operators import aggregates, pairs
from netquant.plans.tables import RUN, network
from netquant.queries.common import NAN, Registry, rounded, snum, sql_mean, with_views

QUERIES = Registry()


@QUERIES.add("gr10_shared_nodes", with_views("shared", "SELECT * FROM shared"))
def gr10_shared_nodes(spark, sf_dir):
    return pairs.pair_members(network(spark, sf_dir).links, RUN)


@QUERIES.add("gr10_shared_by_two_only", with_views("shared sets", """SELECT shared.* FROM shared JOIN sets USING (run_id, peptide_node)
    WHERE n_sharing = 2"""))
def gr10_shared_by_two_only(spark, sf_dir):
    links = network(spark, sf_dir).links
    return pairs.shared_nodes(pairs.pair_members(links, RUN), links, RUN, only_two=True)


def named_sets(rows, links):
    """The text of each set in place of its name."""
    texts = pairs.set_texts(links, pairs.protein_sets(links, RUN), RUN)
    return rows.join(texts, [*RUN, "set_id"]).drop("set_id")


@QUERIES.add("gr11_shared_by_protein_set", with_views("shared sets", """SELECT run_id, node_1, node_2, protein_set, count(*) AS n_shared
    FROM shared JOIN sets USING (run_id, peptide_node) GROUP BY ALL"""))
def gr11_shared_by_protein_set(spark, sf_dir):
    links = network(spark, sf_dir).links
    return named_sets(pairs.shared_by_set(links, RUN), links)


@QUERIES.add("gr12_shared_by_protein", with_views("shared links", """SELECT run_id, node_1, node_2, protein_node, count(*) AS n_shared_nodes
    FROM shared JOIN links USING (run_id, peptide_node) GROUP BY ALL"""))
def gr12_shared_by_protein(spark, sf_dir):
    return pairs.shared_by_protein(network(spark, sf_dir).links, RUN)


SHARING = """SELECT run_id, node_1, node_2, count(DISTINCT protein_node) AS n_sharing
    FROM shared JOIN links USING (run_id, peptide_node) GROUP BY ALL"""


def sharing_table(links):
    sets = cut(pairs.protein_sets(links, RUN), "sets")
    of_set = cut(pairs.set_members(links, sets, RUN), "set-members")
    return pairs.n_sharing(cut(pairs.pair_sets(of_set, RUN), "pair-sets"), of_set, sets, RUN)


@QUERIES.add("gr13_n_sharing", with_views("shared links", SHARING))
def gr13_n_sharing(spark, sf_dir):
    return sharing_table(network(spark, sf_dir).links)


@QUERIES.add("gr9_unique_nodes_loose", with_views("pairs links", """SELECT pairs.*, a.peptide_node FROM pairs
    JOIN links a ON a.run_id = pairs.run_id AND a.protein_node = node_1
    WHERE NOT EXISTS (SELECT 1 FROM links b WHERE b.run_id = pairs.run_id AND b.protein_node = node_2 AND b.peptide_node = a.peptide_node)"""))
def gr9_unique_nodes_loose(spark, sf_dir):
    links = network(spark, sf_dir).links
    return pairs.unique_nodes_of(pairs.protein_pairs(links, RUN), links, "node_1", "node_2", RUN, unique_only=False)


@QUERIES.add("gr15_protein_pairs", with_views("pairs", "SELECT * FROM pairs"))
def gr15_protein_pairs(spark, sf_dir):
    return pairs.protein_pairs(network(spark, sf_dir).links, RUN)


LACKS = """SELECT DISTINCT p.run_id, p.node_1, p.node_2 FROM pairs p JOIN links l ON l.run_id = p.run_id AND l.protein_node = p.{one}
    LEFT JOIN links m ON m.run_id = p.run_id AND m.protein_node = p.{other} AND m.peptide_node = l.peptide_node WHERE m.peptide_node IS NULL"""


@QUERIES.add("gr16_oriented_pairs", with_views("pairs links", f"""SELECT run_id, CASE WHEN keep THEN node_1 ELSE node_2 END AS first_node,
    CASE WHEN keep THEN node_2 ELSE node_1 END AS second_node FROM (SELECT *, CASE WHEN h1 AND NOT h2 THEN true WHEN h2 AND NOT h1 THEN false
    ELSE node_1 > node_2 END AS keep FROM (SELECT pairs.*, a.node_1 IS NOT NULL AS h1, b.node_1 IS NOT NULL AS h2 FROM pairs
      LEFT JOIN ({LACKS.format(one="node_1", other="node_2")}) a ON a.run_id = pairs.run_id AND a.node_1 = pairs.node_1 AND a.node_2 = pairs.node_2
      LEFT JOIN ({LACKS.format(one="node_2", other="node_1")}) b ON b.run_id = pairs.run_id AND b.node_1 = pairs.node_1 AND b.node_2 = pairs.node_2))"""))
def gr16_oriented_pairs(spark, sf_dir):
    links = network(spark, sf_dir).links
    return pairs.orient_pairs(pairs.protein_pairs(links, RUN), links, RUN)


RATIO_VIEWS = {
    "sharing": SHARING,
    "shared_ratio": f"""SELECT run_id, node_1, node_2, protein_set, {sql_mean('log2_ratio')} AS s
    FROM shared JOIN sets USING (run_id, peptide_node) JOIN node_psm USING (run_id, peptide_node) GROUP BY ALL""",
    "unique_ratio": f"""SELECT run_id, protein_node, {sql_mean('log2_ratio')} AS u
    FROM uniq JOIN node_psm USING (run_id, peptide_node) GROUP BY ALL""",
    "pair_ratio": f"""SELECT r.run_id, r.node_1, r.node_2, protein_set, coalesce(a.u, {NAN}) AS u1, s, coalesce(b.u, {NAN}) AS u2, n_sharing
    FROM shared_ratio r JOIN sharing USING (run_id, node_1, node_2)
    LEFT JOIN unique_ratio a ON a.run_id = r.run_id AND a.protein_node = node_1
    LEFT JOIN unique_ratio b ON b.run_id = r.run_id AND b.protein_node = node_2""",
    "classified": f"""SELECT *, CASE WHEN isnan(u1) OR isnan(s) OR isnan(u2) THEN 'CASE6'
      WHEN s BETWEEN lo AND hi THEN
        CASE WHEN d <= 1 THEN 'CASE6'
             WHEN (s > lo + d / 4 AND s < hi - d / 4) OR (isinf(lo) AND isinf(hi) AND NOT isinf(d) AND NOT isinf(s)) THEN 'CASE4'
             ELSE 'CASE3' END
      WHEN s < lo - 1 OR s > hi + 1 THEN CASE WHEN n_sharing > 2 THEN 'CASE2' ELSE 'CASE1' END
      WHEN d > 1 THEN 'CASE3' ELSE 'CASE5' END AS fold_case
    FROM (SELECT *, least(u1, u2) AS lo, greatest(u1, u2) AS hi,
          CASE WHEN u1 = u2 THEN 0 ELSE greatest(u1, u2) - least(u1, u2) END AS d FROM pair_ratio)""",
}
RATIO_NEEDS = "shared sets node_psm uniq links"


def pair_ratio_ids(net, unique_only=True, texts=False):
    stats = aggregates.node_stats(net.psm, net.peptide_nodes, RUN)
    return pairs.pair_ratios(net.links, stats, RUN, unique_only, texts)


def pair_ratio_table(net, unique_only=True):
    return pair_ratio_ids(net, unique_only, texts=True)


@QUERIES.add("pr0_pair_ratios", with_views(RATIO_NEEDS, f"""SELECT run_id, node_1, node_2, protein_set, {snum('u1')} AS u1,
    {snum('s')} AS s, {snum('u2')} AS u2, n_sharing FROM pair_ratio""", RATIO_VIEWS))
def pr0_pair_ratios(spark, sf_dir):
    return rounded(pair_ratio_table(network(spark, sf_dir)), "u1", "s", "u2")


@QUERIES.add("pr1_fold_cases", with_views(RATIO_NEEDS, f"""SELECT run_id, node_1, node_2, protein_set, fold_case,
    fold_case IN ('CASE1', 'CASE2') AS shared_inconsistent,
    CASE WHEN u1 > u2 THEN hi_bad ELSE lo_bad END AS unique_1_inconsistent,
    CASE WHEN u1 > u2 THEN lo_bad ELSE hi_bad END AS unique_2_inconsistent
    FROM (SELECT *, fold_case = 'CASE4' OR (fold_case = 'CASE3' AND CASE WHEN s BETWEEN lo AND hi THEN s > lo + d / 4 OR isinf(lo) ELSE s > hi END) AS lo_bad,
     fold_case = 'CASE4' OR (fold_case = 'CASE3' AND CASE WHEN s BETWEEN lo AND hi THEN s < hi - d / 4 OR isinf(hi) ELSE s < lo END) AS hi_bad
     FROM classified)""", RATIO_VIEWS))
def pr1_fold_cases(spark, sf_dir):
    classified = pairs.classify_fold_change(pair_ratio_table(network(spark, sf_dir)))
    return classified.drop("u1", "s", "u2", "n_sharing")


@QUERIES.add("pr1_fold_cases_loose", with_views(RATIO_NEEDS + " pairs", f"""SELECT run_id, node_1, node_2, protein_set, {snum('u1')} AS u1,
    {snum('u2')} AS u2 FROM loose_ratio""", {**{k: RATIO_VIEWS[k] for k in ("shared_ratio",)},
    "own_1": f"""SELECT pairs.run_id, node_1, node_2, {sql_mean('log2_ratio')} AS u FROM pairs
      JOIN links a ON a.run_id = pairs.run_id AND a.protein_node = node_1
      JOIN node_psm n ON n.run_id = a.run_id AND n.peptide_node = a.peptide_node
      WHERE NOT EXISTS (SELECT 1 FROM links b WHERE b.run_id = pairs.run_id AND b.protein_node = node_2 AND b.peptide_node = a.peptide_node) GROUP BY ALL""",
    "own_2": f"""SELECT pairs.run_id, node_1, node_2, {sql_mean('log2_ratio')} AS u FROM pairs
      JOIN links a ON a.run_id = pairs.run_id AND a.protein_node = node_2
      JOIN node_psm n ON n.run_id = a.run_id AND n.peptide_node = a.peptide_node
      WHERE NOT EXISTS (SELECT 1 FROM links b WHERE b.run_id = pairs.run_id AND b.protein_node = node_1 AND b.peptide_node = a.peptide_node) GROUP BY ALL""",
    "loose_ratio": f"""SELECT r.run_id, r.node_1, r.node_2, protein_set, coalesce(a.u, {NAN}) AS u1, coalesce(b.u, {NAN}) AS u2 FROM shared_ratio r
      LEFT JOIN own_1 a USING (run_id, node_1, node_2) LEFT JOIN own_2 b USING (run_id, node_1, node_2)"""}))
def pr1_fold_cases_loose(spark, sf_dir):
    table = pair_ratio_table(network(spark, sf_dir), unique_only=False)
    return rounded(table, "u1", "u2").drop("s", "n_sharing")


@QUERIES.add("agg17_infinity_helpers", with_views(RATIO_NEEDS, """SELECT run_id, node_1, node_2, protein_set, p + g > 0 AND f > 0 AS mixed, p + g = 3 AS only_infinities,
    f AS n_numbers, CASE WHEN p > 0 AND g = 0 THEN CAST('Infinity' AS DOUBLE) WHEN g > 0 AND p = 0 THEN CAST('-Infinity' AS DOUBLE) END AS same_infinity
    FROM (SELECT *, len(list_filter([u1, s, u2], lambda x: isinf(x) AND x > 0)) AS p, len(list_filter([u1, s, u2], lambda x: isinf(x) AND x < 0)) AS g,
    CAST(len(list_filter([u1, s, u2], lambda x: isfinite(x))) AS INTEGER) AS f FROM pair_ratio)""", RATIO_VIEWS))
def agg17_infinity_helpers(spark, sf_dir):
    """The helpers on the three ratios of each pair."""
    table = pair_ratio_table(network(spark, sf_dir)).withColumn("v", F.array("u1", "s", "u2"))
    return table.select(
        *RUN, "node_1", "node_2", "protein_set", has_finite_and_inf("v").alias("mixed"), all_inf("v").alias("only_infinities"),
        F.size(only_finite("v")).alias("n_numbers"), same_infinity("v").alias("same_infinity"),
    )


def outlier_scores(net, ratios):
    values = aggregates.individual_values(net.psm, net.peptide_nodes, RUN)
    return pairs.outlier_scores(ratios, net.links, values, RUN, unique_only=False)


# Individual values of both sides and the shared set of each pair, then the score of each test.
OUTLIER_VIEWS = {
    "sharing": SHARING,
    "shared_ratio": RATIO_VIEWS["shared_ratio"],
    "vals": f"""SELECT run_id, peptide_node, r FROM (SELECT run_id, peptide_key, {sql_mean('log2_ratio')} AS r FROM psm GROUP BY ALL)
      JOIN peptide_nodes USING (run_id, peptide_key)""",
    "own_nodes": """SELECT pairs.run_id, node_1, node_2, 1 AS side, a.peptide_node FROM pairs
      JOIN links a ON a.run_id = pairs.run_id AND a.protein_node = node_1
      WHERE NOT EXISTS (SELECT 1 FROM links b WHERE b.run_id = pairs.run_id AND b.protein_node = node_2 AND b.peptide_node = a.peptide_node)
      UNION ALL SELECT pairs.run_id, node_1, node_2, 2, a.peptide_node FROM pairs
      JOIN links a ON a.run_id = pairs.run_id AND a.protein_node = node_2
      WHERE NOT EXISTS (SELECT 1 FROM links b WHERE b.run_id = pairs.run_id AND b.protein_node = node_1 AND b.peptide_node = a.peptide_node)""",
    "own_ratio": f"""SELECT run_id, node_1, node_2, side, {sql_mean('log2_ratio')} AS u FROM own_nodes
      JOIN node_psm USING (run_id, peptide_node) GROUP BY ALL""",
    "three": f"""SELECT r.run_id, r.node_1, r.node_2, protein_set, coalesce(a.u, {NAN}) AS u1, s, coalesce(b.u, {NAN}) AS u2, n_sharing
      FROM shared_ratio r JOIN sharing USING (run_id, node_1, node_2)
      LEFT JOIN own_ratio a ON a.run_id = r.run_id AND a.node_1 = r.node_1 AND a.node_2 = r.node_2 AND a.side = 1
      LEFT JOIN own_ratio b ON b.run_id = r.run_id AND b.node_1 = r.node_1 AND b.node_2 = r.node_2 AND b.side = 2""",
    "around": """SELECT run_id, node_1, node_2, protein_set, 'u1' AS part, r FROM three JOIN own_nodes USING (run_id, node_1, node_2)
      JOIN vals USING (run_id, peptide_node) WHERE side = 1 AND isfinite(r)
      UNION ALL SELECT run_id, node_1, node_2, protein_set, 'u2', r FROM three JOIN own_nodes USING (run_id, node_1, node_2)
      JOIN vals USING (run_id, peptide_node) WHERE side = 2 AND isfinite(r)
      UNION ALL SELECT run_id, node_1, node_2, protein_set, 's', r FROM shared JOIN sets USING (run_id, peptide_node)
      JOIN vals USING (run_id, peptide_node) WHERE isfinite(r)""",
    "tested": """SELECT *, unnest(['u1', 's', 'u2']) AS test, unnest([u1, s, u2]) AS x FROM three
      WHERE isfinite(u1) AND isfinite(s) AND isfinite(u2)""",
    "pop": """SELECT run_id, node_1, node_2, protein_set, test, x AS v FROM tested
      UNION ALL SELECT t.run_id, t.node_1, t.node_2, t.protein_set, test, r FROM tested t
      JOIN around a ON a.run_id = t.run_id AND a.node_1 = t.node_1 AND a.node_2 = t.node_2 AND a.protein_set = t.protein_set AND a.part <> t.test""",
    "med": "SELECT run_id, node_1, node_2, protein_set, test, median(v) AS med, count(*) AS n FROM pop GROUP BY ALL",
    "mads": "SELECT run_id, node_1, node_2, protein_set, test, median(abs(v - med)) AS mad FROM pop JOIN med USING (run_id, node_1, node_2, protein_set, test) GROUP BY ALL",
    "scores": """SELECT t.run_id, t.node_1, t.node_2, t.protein_set, test, n AS n_values,
      CASE WHEN mad > 1e-9 THEN 0.6745e0 * abs(x - med) / mad ELSE 0e0 END AS modified_z
      FROM tested t JOIN med USING (run_id, node_1, node_2, protein_set, test) JOIN mads USING (run_id, node_1, node_2, protein_set, test)""",
}
OUTLIER_NEEDS = "shared sets node_psm links pairs"


@QUERIES.add("pr3_modified_z", with_views(OUTLIER_NEEDS, f"SELECT run_id, node_1, node_2, protein_set, test, n_values, {snum('modified_z', 4)} AS modified_z FROM scores", OUTLIER_VIEWS))
def pr3_modified_z(spark, sf_dir):
    net = network(spark, sf_dir)
    ratios = cut(pair_ratio_ids(net, unique_only=False), "pair_ratios")
    return rounded(named_sets(outlier_scores(net, ratios), net.links), "modified_z", digits=4)


@QUERIES.add("pr2_outlier_cases", with_views(OUTLIER_NEEDS, """SELECT run_id, node_1, node_2, protein_set, CASE
      WHEN isnan(u1) OR isnan(s) OR isnan(u2) THEN 'CASE5'
      WHEN isinf(u1) AND isinf(s) AND isinf(u2) THEN CASE WHEN u1 = s AND s = u2 THEN 'CASE4' ELSE 'CASE1' END
      WHEN isinf(u1) OR isinf(s) OR isinf(u2) THEN 'CASE2'
      WHEN nmin < 10 THEN NULL WHEN z1 >= 3.5 OR z2 >= 3.5 THEN 'CASE3'
      WHEN zs >= 3.5 THEN CASE WHEN n_sharing > 2 THEN 'CASE6' ELSE 'CASE7' END ELSE 'CASE0' END AS outlier_case
    FROM three LEFT JOIN (SELECT run_id, node_1, node_2, protein_set, min(n_values) AS nmin,
      max(modified_z) FILTER (test = 'u1') AS z1, max(modified_z) FILTER (test = 's') AS zs, max(modified_z) FILTER (test = 'u2') AS z2
      FROM scores GROUP BY ALL) USING (run_id, node_1, node_2, protein_set)""", OUTLIER_VIEWS))
def pr2_outlier_cases(spark, sf_dir):
    net = network(spark, sf_dir)
    ratios = cut(pair_ratio_ids(net, unique_only=False), "pair_ratios")
    classified = pairs.classify_outlier(ratios, outlier_scores(net, ratios), RUN)
    return named_sets(classified, net.links).drop("u1", "s", "u2", "n_sharing")


@QUERIES.add("pr4_pair_fdr", with_views(RATIO_NEEDS, f"""SELECT *, {snum("n_shared_cases * 100.0 / nullif(n_shared_cases + n_unique_cases / 2.0, 0)")} AS pair_fdr
    FROM (SELECT run_id, count(*) FILTER (fold_case = 'CASE1') AS n_shared_cases,
    count(*) FILTER (fold_case IN ('CASE3', 'CASE4')) AS n_unique_cases FROM classified GROUP BY ALL)""", RATIO_VIEWS))
def pr4_pair_fdr(spark, sf_dir):
    classified = pairs.classify_fold_change(pair_ratio_table(network(spark, sf_dir)))
    return rounded(pairs.pair_fdr(classified, RUN), "pair_fdr")


@QUERIES.add("pr5_case_counts", with_views(RATIO_NEEDS, "SELECT run_id, fold_case, count(*) AS n_pairs FROM classified GROUP BY ALL", RATIO_VIEWS))
def pr5_case_counts(spark, sf_dir):
    return pairs.case_counts(pairs.classify_fold_change(pair_ratio_table(network(spark, sf_dir))), RUN)


@QUERIES.add("pr6_pair_counts", with_views("shared links", f"""SELECT run_id, count(*) AS n_pairs,
    CAST(sum(n_sharing) AS BIGINT) AS n_sharing_total FROM sharing GROUP BY ALL""", {"sharing": SHARING}))
def pr6_pair_counts(spark, sf_dir):
    sharing = cut(sharing_table(network(spark, sf_dir).links), "sharing")
    return pairs.pair_counts(sharing.select(*RUN, "node_1", "node_2"), sharing, RUN)

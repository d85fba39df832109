"""Digestion, positions, sites and modifications on the documents read as protein sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from netquant.functions.sequences import (
    contains_any,
    count_residues,
    full_sequence,
    parse_ptm_specs,
    ptm_code,
    residue_positions,
)
from netquant.lineage import cut
from netquant.operators import filters, positions
from netquant.plans.tables import read
from netquant.queries.common import Registry, with_views

QUERIES = Registry()

PHOSPHO, OXIDATION = 79.966331, 15.994915

_memo: dict = {}


def proteins(spark, sf_dir):
    """Documents as sequences: letters only, upper case, the whole text."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("protein_acc"), letters.alias("sequence")
    )


def _kept(name, spark, sf_dir, build):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _memo:
        _memo[key] = cut(build(), name)
    return _memo[key]


def edges(spark, sf_dir):
    return _kept("digest", spark, sf_dir, lambda: positions.digest(proteins(spark, sf_dir)))


def spans(spark, sf_dir):
    return _kept("spans", spark, sf_dir, lambda: positions.protein_occurrences(edges(spark, sf_dir), proteins(spark, sf_dir)))


def ptms(spark, sf_dir):
    """Modified residues by local motif: S, T or Y before P, and M before E."""
    peptides = edges(spark, sf_dir).select("peptide_key").distinct()
    at = F.explode(residue_positions("peptide_key", "STYM")).alias("position")
    found = peptides.select("peptide_key", at).withColumns(
        {
            "aa": F.substring("peptide_key", F.col("position"), F.lit(1)),
            "_next": F.substring("peptide_key", F.col("position") + 1, F.lit(1)),
        }
    )
    mass = F.when((F.col("aa") != "M") & (F.col("_next") == "P"), PHOSPHO).when(
        (F.col("aa") == "M") & (F.col("_next") == "E"), OXIDATION
    )
    return found.withColumn("delta_mass", mass).filter(F.col("delta_mass").isNotNull()).drop("_next")


SEQ_VIEWS = {
    "prot": "SELECT 'D' || doc_id AS protein_acc, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents",
    "pieces": "SELECT protein_acc, unnest(regexp_extract_all(sequence, '[^KR]*[KR]|[^KR]+')) AS peptide_key FROM prot",
    "pe": "SELECT DISTINCT peptide_key, protein_acc FROM pieces",
    "pl": "SELECT DISTINCT peptide_key, length(peptide_key) AS n FROM pe",
    "lists": "SELECT protein_acc, sequence, regexp_extract_all(sequence, '[^KR]*[KR]|[^KR]+') AS w FROM prot",
    "numbered_pieces": "SELECT protein_acc, unnest(w) AS piece, unnest(range(1, len(w) + 1)) AS i FROM lists",
    "ends": """SELECT protein_acc, piece, length(piece) AS m, sum(length(piece)) OVER (PARTITION BY protein_acc ORDER BY i) AS stop FROM numbered_pieces""",
    "tailed": "SELECT peptide_key, protein_acc, n, least(n, 3) AS k, right(peptide_key, CAST(least(n, 3) AS INTEGER)) AS tail FROM pe JOIN pl USING (peptide_key)",
    "spans": """SELECT peptide_key, e.protein_acc, CAST(stop - n + 1 AS BIGINT) AS start, n FROM tailed p
      JOIN (SELECT *, unnest([1, 2, 3]) AS k FROM ends) e ON e.protein_acc = p.protein_acc AND e.k = p.k AND right(piece, e.k) = tail
      WHERE m >= n AND right(piece, CAST(n AS INTEGER)) = peptide_key AND right(peptide_key, 1) IN ('K', 'R')
      UNION ALL SELECT peptide_key, protein_acc, unnest(list_filter(range(1, length(sequence) - n + 2), lambda i: substring(sequence, i, n) = peptide_key)) AS start, n
      FROM pe JOIN pl USING (peptide_key) JOIN prot USING (protein_acc) WHERE right(peptide_key, 1) NOT IN ('K', 'R')""",
    "letters": "SELECT peptide_key, unnest(range(1, n + 1)) AS position, n FROM pl",
    "lett": "SELECT peptide_key, position, substring(peptide_key, position, 1) AS aa, substring(peptide_key, position + 1, 1) AS nxt FROM letters",
    "sitepos": """SELECT s.peptide_key, protein_acc, position, aa, start + position - 1 AS protein_position
      FROM spans s JOIN lett USING (peptide_key) WHERE aa = 'K'""",
    "ptms": f"""SELECT peptide_key, position, aa, CASE WHEN aa IN ('S', 'T', 'Y') AND nxt = 'P' THEN {PHOSPHO}e0 WHEN aa = 'M' AND nxt = 'E' THEN {OXIDATION}e0 END AS delta_mass
      FROM lett WHERE (aa IN ('S', 'T', 'Y') AND nxt = 'P') OR (aa = 'M' AND nxt = 'E')""",
    "ptmpos": """SELECT s.peptide_key, protein_acc, position, aa, delta_mass, start + position - 1 AS protein_position
      FROM spans s JOIN ptms USING (peptide_key)""",
}


def seq_sql(body: str, extra: dict[str, str] | None = None) -> str:
    return with_views("", body, {**SEQ_VIEWS, **(extra or {})})


@QUERIES.add("dig1_digest", seq_sql("SELECT * FROM pe"))
def dig1_digest(spark, sf_dir):
    return positions.digest(proteins(spark, sf_dir))


@QUERIES.add("dig1_missed_cleavage", seq_sql("""SELECT peptide_key, count(*) AS n_proteins FROM (SELECT DISTINCT protein_acc, peptide_key FROM (
    SELECT protein_acc, p AS peptide_key FROM numbered UNION ALL
    SELECT a.protein_acc, a.p || b.p FROM numbered a JOIN numbered b ON a.protein_acc = b.protein_acc AND b.i = a.i + 1)) GROUP BY ALL""",
    {"numbered": "SELECT protein_acc, unnest(regexp_extract_all(sequence, '[^KR]*[KR]|[^KR]+')) AS p, unnest(range(1, len(regexp_extract_all(sequence, '[^KR]*[KR]|[^KR]+')) + 1)) AS i FROM prot"}))
def dig1_missed_cleavage(spark, sf_dir):
    found = positions.digest(proteins(spark, sf_dir), missed=1)
    return found.groupBy("peptide_key").agg(F.count("*").alias("n_proteins"))


@QUERIES.add("flt1_inclusion_list", seq_sql("""SELECT * FROM pe WHERE peptide_key IN (SELECT unnest(regexp_extract_all(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^KR]*[KR]|[^KR]+')) FROM benchmark)"""))
def flt1_inclusion_list(spark, sf_dir):
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence")
    observed = positions.digest(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("protein_acc"), letters))
    return filters.restrict_to_observed(edges(spark, sf_dir), observed)


@QUERIES.add("dig1_missing_peptides", seq_sql("""SELECT DISTINCT x AS peptide_key FROM (SELECT unnest(regexp_extract_all(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^KR]*[KR]|[^KR]+')) AS x FROM benchmark)
    WHERE x NOT IN (SELECT peptide_key FROM pe)"""))
def dig1_missing_peptides(spark, sf_dir):
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence")
    observed = positions.digest(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("protein_acc"), letters))
    return positions.missing_peptides(observed, edges(spark, sf_dir))


@QUERIES.add("flt6_peptide_pattern", seq_sql("SELECT * FROM pe WHERE regexp_matches(peptide_key, 'N[^P][ST]')"))
def flt6_peptide_pattern(spark, sf_dir):
    return filters.keep_peptides(edges(spark, sf_dir), "N[^P][ST]")


@QUERIES.add("flt14_residues", seq_sql("""SELECT DISTINCT peptide_key, regexp_matches(peptide_key, '[CM]') AS has_any,
    CAST(len(regexp_extract_all(peptide_key, '[CM]')) AS INTEGER) AS n_residues FROM pe"""))
def flt14_residues(spark, sf_dir):
    peptides = edges(spark, sf_dir).select("peptide_key").distinct()
    return peptides.withColumns({"has_any": contains_any("peptide_key", "CM"), "n_residues": count_residues("peptide_key", "CM")})


@QUERIES.add("pos0_occurrences", seq_sql("SELECT peptide_key, protein_acc, CAST(start AS INTEGER) AS start, CAST(start + n - 1 AS INTEGER) AS \"end\" FROM spans"))
def pos0_occurrences(spark, sf_dir):
    return positions.protein_occurrences(edges(spark, sf_dir), proteins(spark, sf_dir))


@QUERIES.add("pos1_site_positions", seq_sql("SELECT peptide_key, protein_acc, CAST(position AS INTEGER) AS position, aa, CAST(protein_position AS INTEGER) AS protein_position FROM sitepos"))
def pos1_site_positions(spark, sf_dir):
    return positions.site_positions(spans(spark, sf_dir), "K")


@QUERIES.add("pos2_ptm_positions", seq_sql("SELECT peptide_key, protein_acc, CAST(position AS INTEGER) AS position, aa, delta_mass, CAST(protein_position AS INTEGER) AS protein_position FROM ptmpos"))
def pos2_ptm_positions(spark, sf_dir):
    return positions.ptm_positions(spans(spark, sf_dir), ptms(spark, sf_dir))


@QUERIES.add("pos3_covering", seq_sql("""SELECT peptide_key, protein_acc, CAST(start AS INTEGER) AS start, CAST(start + n - 1 AS INTEGER) AS "end" FROM spans s
    WHERE EXISTS (SELECT 1 FROM ptmpos q WHERE q.protein_acc = s.protein_acc AND q.protein_position BETWEEN s.start AND s.start + s.n - 1)"""))
def pos3_covering(spark, sf_dir):
    found = spans(spark, sf_dir)
    return positions.covering(found, positions.ptm_positions(found, ptms(spark, sf_dir)))


@QUERIES.add("pos5_position_sets", seq_sql("""SELECT protein_acc, array_to_string(list_sort(list_filter(k, lambda x: NOT list_contains(p, x))), ' ') AS only_sites,
    list_has_any(k, p) AS any_common, array_to_string(list_sort(list_intersect(k, p)), ' ') AS common, list_sort(k) = list_sort(p) AS equal FROM
    (SELECT protein_acc, list(DISTINCT CAST(protein_position AS INTEGER)) AS k FROM sitepos GROUP BY ALL)
    JOIN (SELECT protein_acc, list(DISTINCT CAST(protein_position + 1 AS INTEGER)) AS p FROM ptmpos GROUP BY ALL) USING (protein_acc)"""))
def pos5_position_sets(spark, sf_dir):
    """Sites against the residues next to a modification, per protein (sets within one sequence)."""
    found = spans(spark, sf_dir)
    k = positions.site_positions(found, "K").groupBy("protein_acc").agg(F.collect_set("protein_position").alias("k"))
    near = F.collect_set(F.col("protein_position") + 1).alias("p")
    p = positions.ptm_positions(found, ptms(spark, sf_dir)).groupBy("protein_acc").agg(near)
    a, b = F.col("k"), F.col("p")
    text = lambda c: F.array_join(c.cast("array<string>"), " ")
    return k.join(p, "protein_acc").select(
        "protein_acc", text(positions.only_first(a, b)).alias("only_sites"), positions.share_any(a, b).alias("any_common"),
        text(positions.common(a, b)).alias("common"), positions.same_positions(a, b).alias("equal"),
    )


SITE_NODES = {
    "placed": "SELECT DISTINCT peptide_key, position, protein_acc || '#' || aa || protein_position AS place FROM sitepos",
    "keyed": "SELECT peptide_key, position, string_agg(place, '-' ORDER BY place) AS site_key FROM placed GROUP BY ALL",
}


@QUERIES.add("gr5_site_nodes", seq_sql("""SELECT first_value(peptide_key || '@' || position) OVER (PARTITION BY site_key ORDER BY peptide_key, position) AS site_node,
    site_key, peptide_key, CAST(position AS INTEGER) AS position FROM keyed""", SITE_NODES))
def gr5_site_nodes(spark, sf_dir):
    return positions.collapse_by_site(positions.site_positions(spans(spark, sf_dir), "K"))


@QUERIES.add("gr6_ptm_nodes", seq_sql("""SELECT first_value(peptide_key || '@' || position) OVER (PARTITION BY site_key ORDER BY peptide_key, position) AS site_node,
    site_key, peptide_key, CAST(position AS INTEGER) AS position FROM (SELECT peptide_key, position, string_agg(place, '-' ORDER BY place) AS site_key FROM
    (SELECT DISTINCT peptide_key, position, protein_acc || '#' || aa || protein_position || '(' || printf('%+.2f', delta_mass) || ')' AS place FROM ptmpos) GROUP BY ALL)"""))
def gr6_ptm_nodes(spark, sf_dir):
    return positions.collapse_by_ptm(positions.ptm_positions(spans(spark, sf_dir), ptms(spark, sf_dir)))


@QUERIES.add("fn10_position_strings", seq_sql("""SELECT peptide_key, string_agg(t, '-' ORDER BY t) AS positions FROM
    (SELECT peptide_key, protein_acc || '#' || string_agg(DISTINCT aa || protein_position, '#' ORDER BY aa || protein_position) AS t FROM sitepos GROUP BY peptide_key, protein_acc) GROUP BY ALL"""))
def fn10_position_strings(spark, sf_dir):
    return positions.position_strings(positions.site_positions(spans(spark, sf_dir), "K"))


@QUERIES.add("fn10_peptide_positions", seq_sql("""SELECT peptide_key, peptide_key || '#' || string_agg(DISTINCT aa || position, '#' ORDER BY aa || position) AS positions FROM sitepos GROUP BY peptide_key"""))
def fn10_peptide_positions(spark, sf_dir):
    return positions.peptide_position_strings(positions.site_positions(spans(spark, sf_dir), "K"))


@QUERIES.add("fn11_site_labels", seq_sql("""SELECT peptide_key, CASE WHEN n_sites = 0 THEN 'not found' WHEN coalesce(n_places, 0) = 0 THEN '-'
    WHEN n_places > 1 THEN 'ambiguous' ELSE place END AS site FROM (SELECT DISTINCT peptide_key, len(regexp_extract_all(peptide_key, 'K')) AS n_sites FROM pe)
    LEFT JOIN (SELECT peptide_key, count(DISTINCT protein_acc || '#' || aa || protein_position) AS n_places, min(protein_acc || '#' || aa || protein_position) AS place FROM sitepos GROUP BY ALL) USING (peptide_key)"""))
def fn11_site_labels(spark, sf_dir):
    place = F.concat("protein_acc", F.lit("#"), "aa", F.col("protein_position").cast("string"))
    placed = positions.site_positions(spans(spark, sf_dir), "K").groupBy("peptide_key").agg(
        F.countDistinct(place).alias("n_places"), F.min(place).alias("place")
    )
    peptides = edges(spark, sf_dir).select("peptide_key").distinct().withColumn("n_sites", count_residues("peptide_key", "K"))
    label = positions.site_label(F.col("n_sites"), F.col("n_places"), F.col("place"))
    return peptides.join(placed, "peptide_key", "left").select("peptide_key", label.alias("site"))


@QUERIES.add("flt4_keep_ptm", seq_sql("SELECT DISTINCT peptide_key FROM ptms WHERE (aa IN ('S', 'T') AND delta_mass = 79.966331e0) OR aa = 'M'"))
def flt4_keep_ptm(spark, sf_dir):
    held = ptms(spark, sf_dir).groupBy("peptide_key").agg(F.collect_list(F.struct("position", "aa", "delta_mass")).alias("ptms"))
    return filters.keep_ptm(held, parse_ptm_specs("+79.966331@ST, M")).select("peptide_key")


@QUERIES.add("fn8_ptm_codes", seq_sql("SELECT delta_mass, CASE dense_rank() OVER (ORDER BY delta_mass) WHEN 1 THEN '*' WHEN 2 THEN '@' END AS code, count(*) AS n FROM ptms GROUP BY delta_mass"))
def fn8_ptm_codes(spark, sf_dir):
    found = ptms(spark, sf_dir)
    masses = found.agg(F.array_sort(F.collect_set("delta_mass"))).scalar()
    counts = found.groupBy("delta_mass").agg(F.count("*").alias("n")).withColumn("_all", masses)
    return counts.select("delta_mass", ptm_code(F.col("delta_mass"), F.col("_all")).alias("code"), "n")


@QUERIES.add("src0_full_sequences", seq_sql("""SELECT peptide_key, string_agg(aa || CASE WHEN (aa IN ('S', 'T', 'Y') AND nxt = 'P') THEN '[+79.97]' WHEN aa = 'M' AND nxt = 'E' THEN '[+15.99]' ELSE '' END, '' ORDER BY position) AS full_sequence
    FROM lett WHERE peptide_key IN (SELECT peptide_key FROM ptms) GROUP BY ALL"""))
def src0_full_sequences(spark, sf_dir):
    mark = F.struct(F.col("position").alias("pos"), "aa", "delta_mass")
    held = ptms(spark, sf_dir).groupBy("peptide_key").agg(F.collect_list(mark).alias("ptms"))
    return held.select("peptide_key", full_sequence("peptide_key", "ptms").alias("full_sequence"))


STATE_VIEWS = {
    "marks": "SELECT DISTINCT protein_acc, peptide_key, protein_position, aa, delta_mass FROM ptmpos",
    "places": "SELECT DISTINCT protein_acc, protein_position, aa, delta_mass FROM marks",
    "few": "SELECT protein_acc, list(protein_position ORDER BY protein_position) AS pl FROM places GROUP BY ALL HAVING count(*) <= 4",
    "own": "SELECT protein_acc, peptide_key, list(DISTINCT protein_position) AS own FROM marks GROUP BY ALL",
    "cand": """SELECT protein_acc, list_filter(pl, lambda x: (m >> (list_position(pl, x) - 1)) % 2 = 1) AS st FROM
      (SELECT *, unnest(range(1, CAST(1 << len(pl) AS BIGINT))) AS m FROM few)""",
    "states": """SELECT c.protein_acc, st FROM cand c JOIN own o ON o.protein_acc = c.protein_acc AND list_has_all(st, own)
      GROUP BY c.protein_acc, st HAVING len(list_distinct(flatten(list(own)))) = len(st)""",
    "keyed_states": """SELECT s.protein_acc, st, s.protein_acc || '_' || array_to_string(list_transform(st, lambda x: k[list_position(p, x)]), ',') AS state_key FROM states s JOIN
      (SELECT protein_acc, list(protein_position ORDER BY protein_position) AS p, list(aa || protein_position || CASE WHEN aa = 'M' THEN '(*)' ELSE '(@)' END ORDER BY protein_position) AS k FROM places GROUP BY ALL) USING (protein_acc)""",
    "att": """SELECT s.protein_acc, state_key, s.peptide_key, bool_and(CASE WHEN own IS NOT NULL THEN
        list_has_all(st, own) AND len(list_filter(st, lambda x: x BETWEEN start AND start + n - 1 AND NOT list_contains(own, x))) = 0
        ELSE len(list_filter(st, lambda x: x BETWEEN start AND start + n - 1)) = 0 END) AS fits, bool_or(own IS NOT NULL) AS modified
      FROM spans s JOIN keyed_states USING (protein_acc) LEFT JOIN own o ON o.protein_acc = s.protein_acc AND o.peptide_key = s.peptide_key GROUP BY ALL""",
}


@QUERIES.add("gr7_protein_states", seq_sql("SELECT protein_acc, state_key, CAST(len(st) AS INTEGER) AS n_positions FROM keyed_states", STATE_VIEWS))
def gr7_protein_states(spark, sf_dir):
    found, mods = spans(spark, sf_dir), ptms(spark, sf_dir)
    states, _ = positions.protein_ptm_states(found, positions.ptm_positions(found, mods), mods)
    return states.select("protein_acc", "state_key", F.size("state_positions").alias("n_positions"))


@QUERIES.add("gr7_state_edges", seq_sql("""SELECT protein_acc, state_key, peptide_key FROM att WHERE fits
    UNION ALL SELECT DISTINCT protein_acc, NULL, peptide_key FROM spans s WHERE NOT EXISTS
    (SELECT 1 FROM att a WHERE a.fits AND a.modified AND a.protein_acc = s.protein_acc AND a.peptide_key = s.peptide_key)""", STATE_VIEWS))
def gr7_state_edges(spark, sf_dir):
    found, mods = spans(spark, sf_dir), ptms(spark, sf_dir)
    _, rewired = positions.protein_ptm_states(found, positions.ptm_positions(found, mods), mods)
    return rewired


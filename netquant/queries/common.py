"""Helpers shared by the query modules: output forms on the Spark side, views on the SQL side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquant.queries import Query


class Registry(dict):
    """Query name -> :class:`Query`."""

    def add(self, name: str, sql: str | None = None) -> Callable:
        def keep(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            self[name] = Query(run, sql)
            return run

        return keep


def num(c: str | Column, digits: int = 6) -> Column:
    """Rounded double; NaN becomes null and -0.0 becomes 0.0, so both engines print the same."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), F.round(c.cast("double"), digits) + F.lit(0.0))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: num(c, digits) for c in columns})


def snum(x: str, digits: int = 6) -> str:
    """SQL twin of :func:`num`."""
    return f"CASE WHEN NOT isnan(CAST({x} AS DOUBLE)) THEN round(CAST({x} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) END"


INF = "CAST('Infinity' AS DOUBLE)"
NEG = "CAST('-Infinity' AS DOUBLE)"
NAN = "CAST('NaN' AS DOUBLE)"


def sfinite(x: str) -> str:
    return f"isfinite({x})"


def sql_counts(x: str) -> dict[str, str]:
    """Aggregate texts over the values ``x``."""
    return {
        "n": f"count({x})",
        "p": f"count(*) FILTER ({x} = {INF})",
        "g": f"count(*) FILTER ({x} = {NEG})",
        "z": f"count(*) FILTER (isnan({x}))",
        "f": f"count(*) FILTER (isfinite({x}))",
        "m": f"coalesce(avg({x}) FILTER (isfinite({x})), {NAN})",
        "s": f"coalesce(stddev_samp({x}) FILTER (isfinite({x})), {NAN})",
    }


def sql_mean(x: str) -> str:
    """SQL text of the infinity-aware mean with the majority rule."""
    k = sql_counts(x)
    n, p, g, z, f, m = k["n"], k["p"], k["g"], k["z"], k["f"], k["m"]
    return f"""CASE WHEN {n} = 0 THEN NULL WHEN {p} = {n} THEN {INF} WHEN {g} = {n} THEN {NEG} WHEN {z} = {n} THEN {NAN}
      WHEN {p} + {g} <= {f} THEN {m}
      WHEN {g} = 0 THEN {INF} WHEN {p} = 0 THEN {NEG}
      WHEN {p} > {g} THEN CASE WHEN {p} > {f} THEN {INF} WHEN {p} < {f} OR {m} > 0 THEN {m} ELSE {NAN} END
      WHEN {g} > {p} THEN CASE WHEN {g} > {f} THEN {NEG} WHEN {g} < {f} OR {m} < 0 THEN {m} ELSE {NAN} END
      WHEN {f} > {g} THEN {m}
      WHEN {f} = {g} AND {m} > 4 THEN {INF} WHEN {f} = {g} AND {m} < -4 THEN {NEG}
      ELSE {NAN} END"""


def sql_n(x: str) -> str:
    """SQL text of the number of values behind :func:`sql_mean`."""
    k = sql_counts(x)
    n, p, g, z, f, m = k["n"], k["p"], k["g"], k["z"], k["f"], k["m"]
    return f"""CASE WHEN {n} IN (0, {p}, {g}, {z}) THEN {n}
      WHEN {p} + {g} <= {f} THEN {f}
      WHEN {g} = 0 OR {p} = 0 THEN {p} + {g}
      WHEN {p} > {g} THEN CASE WHEN {p} > {f} THEN {p} WHEN {p} < {f} OR {m} > 0 THEN {f} ELSE {p} + {f} END
      WHEN {g} > {p} THEN CASE WHEN {g} > {f} THEN {g} WHEN {g} < {f} OR {m} < 0 THEN {f} ELSE {g} + {f} END
      WHEN {f} > {g} THEN {f}
      WHEN {f} = {g} AND {m} > 4 THEN {p} + {f} WHEN {f} = {g} AND {m} < -4 THEN {g} + {f}
      ELSE {p} + {g} END"""


def sql_sd(x: str) -> str:
    """SQL text of the spread that goes with :func:`sql_mean`."""
    k = sql_counts(x)
    n, p, g, z, f, m, s = (k[c] for c in "npgzfms")
    return f"""CASE WHEN {n} = 0 OR {z} = {n} THEN {NAN} WHEN {p} = {n} THEN {INF} WHEN {g} = {n} THEN {NEG}
      WHEN {p} + {g} <= {f} THEN {s}
      WHEN {g} = 0 THEN {INF} WHEN {p} = 0 THEN {NEG}
      WHEN {p} > {g} THEN CASE WHEN {p} > {f} THEN {INF} WHEN {p} < {f} OR {m} > 0 THEN {s} ELSE {NAN} END
      WHEN {g} > {p} THEN CASE WHEN {g} > {f} THEN {NAN} WHEN {g} < {f} OR {m} < 0 THEN {s} ELSE {NAN} END
      WHEN {f} > {g} THEN {s} ELSE {NAN} END"""


# Views, each built on those before it.
VIEWS = {
    "psm": f"""SELECT CAST(year(l_shipdate) AS VARCHAR) || CASE WHEN month(l_shipdate) <= 6 THEN 'H1' ELSE 'H2' END AS run_id,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS psm_id,
    'P' || l_partkey AS peptide_key, 'O' || l_orderkey AS protein_acc, l_returnflag AS experiment,
    l_returnflag || l_linestatus AS replicate, 'R' || (l_suppkey % 5) AS raw_file, l_linenumber AS charge,
    l_discount AS numerator, l_tax AS denominator, l_extendedprice AS weight, l_quantity AS ions,
    (l_discount > 0) <> (l_tax > 0) AS singleton,
    CASE WHEN l_discount > 0 AND l_tax > 0 THEN log2(l_discount / l_tax)
         WHEN l_discount > 0 THEN {INF} WHEN l_tax > 0 THEN {NEG} ELSE {NAN} END AS log2_ratio
    FROM lineitem""",
    "protein": """SELECT 'O' || o_orderkey AS protein_acc, c_name AS gene, r_name AS taxonomy, o_orderpriority AS description
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""",
    "edges": "SELECT DISTINCT run_id, peptide_key, protein_acc FROM psm",
    "hop": """SELECT DISTINCT a.run_id, a.protein_acc AS v, b.protein_acc AS w
    FROM edges a JOIN edges b USING (run_id, peptide_key)""",
    "reach": """SELECT run_id, v, w FROM hop
    UNION SELECT r.run_id, r.v, h.w FROM reach r JOIN hop h ON r.run_id = h.run_id AND r.w = h.v""",
    "cluster_of": "SELECT run_id, v AS protein_acc, min(w) AS cluster_id FROM reach GROUP BY run_id, v",
    "cluster_peptides": "SELECT DISTINCT run_id, cluster_id, peptide_key FROM edges JOIN cluster_of USING (run_id, protein_acc)",
    "peptide_sets": """SELECT run_id, peptide_key, string_agg(protein_acc, ' ' ORDER BY protein_acc) AS sig
    FROM edges GROUP BY run_id, peptide_key""",
    "protein_sets": """SELECT run_id, protein_acc, string_agg(peptide_key, ' ' ORDER BY peptide_key) AS sig
    FROM edges GROUP BY run_id, protein_acc""",
    "peptide_nodes": """SELECT run_id, peptide_key, min(peptide_key) OVER (PARTITION BY run_id, sig) AS peptide_node
    FROM peptide_sets""",
    "protein_nodes": """SELECT run_id, protein_acc, min(protein_acc) OVER (PARTITION BY run_id, sig) AS protein_node
    FROM protein_sets""",
    "links": """SELECT DISTINCT run_id, peptide_node, protein_node FROM edges
    JOIN peptide_nodes USING (run_id, peptide_key) JOIN protein_nodes USING (run_id, protein_acc)""",
    "node_psm": "SELECT * FROM psm JOIN peptide_nodes USING (run_id, peptide_key)",
    "uniq": """SELECT run_id, peptide_node, min(protein_node) AS protein_node FROM links
    GROUP BY run_id, peptide_node HAVING count(*) = 1""",
    "shared": """SELECT a.run_id, a.protein_node AS node_1, b.protein_node AS node_2, a.peptide_node
    FROM links a JOIN links b ON a.run_id = b.run_id AND a.peptide_node = b.peptide_node AND a.protein_node < b.protein_node""",
    "pairs": "SELECT DISTINCT run_id, node_1, node_2 FROM shared",
    "sets": """SELECT run_id, peptide_node, string_agg(protein_node, ' ' ORDER BY protein_node) AS protein_set,
    count(*) AS n_sharing FROM links GROUP BY run_id, peptide_node""",
}

DEPENDS = {
    "psm": [], "protein": [], "edges": ["psm"], "hop": ["edges"], "reach": ["hop"], "cluster_of": ["reach"],
    "cluster_peptides": ["edges", "cluster_of"], "peptide_sets": ["edges"], "protein_sets": ["edges"],
    "peptide_nodes": ["peptide_sets"], "protein_nodes": ["protein_sets"],
    "links": ["edges", "peptide_nodes", "protein_nodes"], "node_psm": ["psm", "peptide_nodes"],
    "uniq": ["links"], "shared": ["links"], "pairs": ["shared"], "sets": ["links"],
}


def with_views(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the named views and all they rest on, then the extra ones, as CTEs."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in DEPENDS.get(name, []):
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{name} AS ({VIEWS[name]})" for name in order]
    parts += [f"{name} AS ({text})" for name, text in (extra or {}).items()]
    recursive = "RECURSIVE " if "reach" in order else ""
    return (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + body

"""Proteomics views on the star-schema tables, so that every operator runs on whole tables.

A PSM is a line item, a peptide a part, a protein an order and a run the half-year of shipping:
the runs are analysed side by side in one job through the ``run_id`` key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquant.functions.ratios import safe_log2_ratio
from netquant.lineage import cut
from netquant.operators import components, nodes

RUN = ("run_id",)
REPLICATES = ("AF", "AO", "NF", "NO", "RF", "RO")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def psm_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSMs of all runs: one row per line item."""
    item = read(spark, sf_dir, "lineitem")
    half = F.when(F.month("l_shipdate") <= 6, "H1").otherwise("H2")
    return item.select(
        F.concat(F.year("l_shipdate").cast("string"), half).alias("run_id"),
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").cast("string")
        ).alias("psm_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("peptide_key"),
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("protein_acc"),
        F.col("l_returnflag").alias("experiment"),
        F.concat("l_returnflag", "l_linestatus").alias("replicate"),
        F.concat(F.lit("R"), (F.col("l_suppkey") % 5).cast("string")).alias("raw_file"),
        F.col("l_linenumber").alias("charge"),
        F.col("l_discount").alias("numerator"),
        F.col("l_tax").alias("denominator"),
        F.col("l_extendedprice").alias("weight"),
        F.col("l_quantity").alias("ions"),
        ((F.col("l_discount") > 0) != (F.col("l_tax") > 0)).alias("singleton"),
        safe_log2_ratio("l_discount", "l_tax").alias("log2_ratio"),
    )


def protein_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protein annotation: one row per order."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("protein_acc"),
            F.col("c_name").alias("gene"),
            F.col("r_name").alias("taxonomy"),
            F.col("o_orderpriority").alias("description"),
        )
    )


@dataclass
class Network:
    """The graph of all runs; the derived tables are written once per session and folder."""

    psm: DataFrame
    protein: DataFrame
    edges: DataFrame
    _tables: dict[str, DataFrame] = field(default_factory=dict)

    def _table(self, name: str, build) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = cut(build(), name)
        return self._tables[name]

    @property
    def cluster_of(self) -> DataFrame:
        return self._table("cluster_of", lambda: components.clusters(self.edges, RUN))

    @property
    def peptide_nodes(self) -> DataFrame:
        return self._table("peptide_nodes", lambda: nodes.collapse_peptides(self.edges, RUN))

    @property
    def protein_nodes(self) -> DataFrame:
        return self._table("protein_nodes", lambda: nodes.collapse_proteins(self.edges, RUN))

    @property
    def links(self) -> DataFrame:
        return self._table("links", lambda: nodes.node_edges(self.edges, self.peptide_nodes, self.protein_nodes, RUN))

    @property
    def cluster_peptides(self) -> DataFrame:
        return components.cluster_peptides(self.edges, self.cluster_of, RUN)


_networks: dict[tuple[str, str], Network] = {}


def network(spark: SparkSession, sf_dir: str, fresh: bool = False) -> Network:
    """The network of a table folder; ``fresh`` builds it anew (timing)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if fresh or key not in _networks:
        psm = psm_table(spark, sf_dir)
        edges = cut(nodes.peptide_protein_edges(psm, by=RUN), "edges")
        _networks[key] = Network(psm, protein_table(spark, sf_dir), edges)
    return _networks[key]

"""Writers: tab-separated tables, parquet tables and tables split by a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(table: DataFrame, path: str) -> None:
    """Tab-separated parts with a header, in the order of the table."""
    table.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="")


def write_parquet(table: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = table.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_network(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables side by side."""
    write_parquet(nodes, f"{path}/net_nodes")
    write_parquet(edges, f"{path}/net_edges")


def unfinished(groups: DataFrame, done: DataFrame) -> DataFrame:
    """Comparisons without rows in an earlier output."""
    return groups.join(done.select("comparison_id").distinct(), "comparison_id", "left_anti")


def replicate_matrices(means: DataFrame, replicates: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Gene x replicate matrix of mean ratios and that of their inverses."""
    def wide(value: str) -> DataFrame:
        return means.groupBy(*keys).pivot("replicate", list(replicates)).agg(F.first(value)).orderBy(*keys)

    return wide("mean_ratio"), wide("inverse_ratio")

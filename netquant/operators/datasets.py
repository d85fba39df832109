"""Comparison of filtered datasets by their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Separators of composite keys by kind (fixed values).
KEY_SEPARATORS = {"peptide_node": "_", "protein": ","}


def within_fdr(table: DataFrame, fdr_max: float) -> DataFrame:
    """Rows at or below the FDR; missing ones do not pass."""
    return table.filter(F.col("fdr").isNotNull() & ~F.isnan("fdr") & (F.col("fdr") <= fdr_max))


def split_keys(table: DataFrame, kind: str, column: str = "key") -> DataFrame:
    """One row per part of a composite key."""
    return table.withColumn(column, F.explode(F.split(column, KEY_SEPARATORS[kind])))


def regions(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(key, region)``: which datasets hold each key, as the joined names; ``rows`` is (dataset, key)."""
    flags = [F.bool_or(F.col("dataset") == name).alias(f"_{i}") for i, name in enumerate(names)]
    text = F.concat_ws("&", *[F.when(F.col(f"_{i}"), F.lit(name)) for i, name in enumerate(names)])
    return rows.groupBy("key").agg(*flags).select("key", text.alias("region"))


def region_counts(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return regions(rows, names).groupBy("region").agg(F.count("*").alias("n_keys"))


def in_all(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keys of every dataset."""
    return regions(rows, names).filter(F.col("region") == "&".join(names)).select("key")


def only_in(rows: DataFrame, names: Sequence[str], name: str) -> DataFrame:
    """Keys of one dataset and of no other."""
    return regions(rows, names).filter(F.col("region") == name).select("key")


def element_regions(rows: DataFrame, names: Sequence[str], kind: str) -> DataFrame:
    """Region of each composite element: an element is in a dataset when any of its parts is.

    ``rows`` is (dataset, key) with composite keys; returns ``(dataset, element, region)``.
    """
    parts = rows.withColumn("element", F.col("key")).withColumn("key", F.explode(F.split("key", KEY_SEPARATORS[kind])))
    held = parts.groupBy("key").agg(*[F.bool_or(F.col("dataset") == n).alias(f"_{i}") for i, n in enumerate(names)])
    joined = parts.join(held, "key").groupBy("dataset", "element").agg(*[F.bool_or(f"_{i}").alias(f"_{i}") for i in range(len(names))])
    text = F.concat_ws("&", *[F.when(F.col(f"_{i}"), F.lit(name)) for i, name in enumerate(names)])
    return joined.select("dataset", "element", text.alias("region"))

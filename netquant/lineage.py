"""Lineage cuts: iterative operators write each round as a table in the shared checkpoint folder.

A written parquet table is used rather than ``DataFrame.checkpoint()`` because it computes the
plan once, keeps the columns encoded, gives the next round exact sizes for its join choices and
survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one only for a local master without it."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError(f"{SETTING} must name a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="netquant-")
    spark.conf.set(SETTING, folder)
    return folder


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/netquant/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

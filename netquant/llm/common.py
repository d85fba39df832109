"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def byte_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, so that memory doesn't follow the row count."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(column))
        lengths = pc.binary_length(sizes).fill_null(0).to_pylist()
        first = held = 0
        for at, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(first, at - first)
                first, held = at, 0
            held += n
        if first < batch.num_rows:
            yield batch.slice(first)


def hook(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Join the sets of linked rows; afterwards every row points to its root."""
    while len(x):
        a, b = parent[x], parent[y]
        apart = a != b
        if not apart.any():
            break
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent

"""Registered queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def catalog() -> dict[str, Query]:
    from netquant.queries import comparison, graph, integration, pairing, reporting, sequences

    found: dict[str, Query] = {}
    for module in (graph, pairing, comparison, sequences, integration, reporting):
        for name, query in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} registered twice")
            found[name] = query
    return found

"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

from __future__ import annotations


def catalog() -> dict:
    """Query name -> :class:`netquant.queries.Query` of every operator here and of the pipeline."""
    from netquant.llm.queries import QUERIES

    return dict(QUERIES)

"""Operators for training-data pipelines, their queries and SQL twins."""

from __future__ import annotations


def load():
    from plumbline.llm import queries

    return dict(queries.QUERIES), dict(queries.TWINS)

"""All queries of the engine."""

from __future__ import annotations

from . import features, graphs, modelling, monitoring  # noqa: F401
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)

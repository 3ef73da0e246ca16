"""Registered queries, one module per group of operators."""

from tidegrid.queries import (  # noqa: F401
    evaluation,
    files,
    learning,
    screening,
    selection,
    tables,
    windows,
)
from tidegrid.queries.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

"""All named queries, and those that SQL can state with their oracle."""

from . import assessment, corpus, evaluation, graph, search, sinks, trace  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

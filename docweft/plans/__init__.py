"""Registered queries over the driver tables, with their SQL twins."""

from . import checks, documents, files, graph, history, logs, texts  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

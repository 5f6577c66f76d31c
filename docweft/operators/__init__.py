"""Operators over the document, graph and history tables."""

"""Embervane: text embedding, semantic search and corpus processing as PySpark DataFrame operators."""

__version__ = "0.1.0"

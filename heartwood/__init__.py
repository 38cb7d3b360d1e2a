"""Spark-native document-tree indexing and retrieval."""

__version__ = "0.1.0"

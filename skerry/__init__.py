"""Spark-native passage indexing and retrieval."""

__version__ = "0.1.0"

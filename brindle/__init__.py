"""Spark-native retrieval, topic analytics and text-data operators."""

__version__ = "0.1.0"

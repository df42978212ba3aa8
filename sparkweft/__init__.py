"""Spark-native graph, factor-graph and corpus analytics."""

__version__ = "0.1.0"

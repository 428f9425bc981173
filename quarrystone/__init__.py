"""Spark-native structural analytics over source code, tables and text corpora."""

__version__ = "0.1.0"

"""Readloom: Spark-native analytics for long-read sequence data."""

__version__ = "0.1.0"

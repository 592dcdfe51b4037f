"""Quillon: a Spark-native analytics engine for finite, provenance-aware numerical research data."""

__version__ = "0.1.0"

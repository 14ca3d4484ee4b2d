"""Spark-native engine for finding slowly moving sources in sky-located event catalogues."""

__version__ = "0.1.0"

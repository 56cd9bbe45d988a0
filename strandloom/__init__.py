"""Spark-native transcript quantification and large-scale record processing."""

__version__ = "0.1.0"

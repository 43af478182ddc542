"""Spark-native data catalog, governance and lineage over DataFrames."""

__version__ = "0.1.0"

"""Spark-native genomics analytics: sources, sinks, functions and plans over DataFrames."""

__version__ = "0.1.0"

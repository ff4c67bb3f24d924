"""Spark-native narrative analytics: sources, functions, operators, plans and streaming jobs."""

__version__ = "0.1.0"

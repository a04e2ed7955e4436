"""Spark-native detection of under-performing strings and inverters."""

__version__ = "0.1.0"

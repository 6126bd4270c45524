"""Tallyloom: a Spark-native engine for reconciling two sets of records."""

__version__ = "0.1.0"

"""Spark-native analytics engine: small DataFrame operators, query plans and a registry."""

__version__ = "0.1.0"

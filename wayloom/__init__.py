"""Wayloom: batch ingestion and data preparation expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"

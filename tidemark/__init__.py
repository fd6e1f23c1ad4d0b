"""Tidemark: market-microstructure analytics as Spark DataFrame transformations."""

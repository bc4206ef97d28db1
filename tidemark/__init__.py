"""Tidemark: Spark-native analytics for unlabelled telemetry kept as date-partitioned Parquet."""

__version__ = "0.1.0"

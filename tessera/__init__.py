"""Spark-native analytics for evidence, retrieval and corpus workloads."""

"""Spark-native full-text retrieval and analytics."""

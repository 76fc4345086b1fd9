"""Spark-native literature-graph analytics."""

"""Spark-native news analytics."""

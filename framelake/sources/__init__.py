"""Spark-native trajectory analytics: sources."""

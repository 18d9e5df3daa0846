"""Spark-native trajectory analytics: streaming."""

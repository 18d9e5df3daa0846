"""Spark-native trajectory analytics: plans."""

"""Spark-native trajectory analytics: operators."""

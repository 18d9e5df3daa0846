"""Spark-native trajectory analytics: functions."""

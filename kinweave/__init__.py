"""Spark-native record linkage engine."""

"""Spark-native analytics for collector-network planning."""

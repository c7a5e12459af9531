"""Spark-native analytics over property graphs."""

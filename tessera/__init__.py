"""Spark-native analytics for text-heavy registries."""

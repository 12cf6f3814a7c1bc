"""Spark-native analytics for finding copied media in batch and streaming data."""

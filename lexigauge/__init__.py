"""Spark-native analytics for document-text evaluation: scoring, ranking and ranking stability."""

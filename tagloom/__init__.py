"""Spark-native tagging, search and page-analytics engine."""

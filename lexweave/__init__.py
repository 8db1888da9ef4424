"""Spark-native analytics for comparative wordlists."""

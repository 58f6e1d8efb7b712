"""Spark-native text-authorship analytics."""

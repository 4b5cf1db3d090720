"""Spark-native analytics for judging structured-document extraction."""

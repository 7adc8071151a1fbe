"""Spark-native analytics for instrument time series."""

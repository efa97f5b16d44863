"""Spark-native analytics for daily price series, listings and forecasts."""

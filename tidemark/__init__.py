"""Spark-native analytics for daily market-risk research on long, series-partitioned bar data."""

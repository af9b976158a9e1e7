"""A Spark-native engine for keyed and time-series tables."""

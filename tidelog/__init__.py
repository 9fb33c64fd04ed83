"""A Spark-native engine for keyed, log-structured data."""

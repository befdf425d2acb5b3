"""A Spark-native engine for order-book market data."""

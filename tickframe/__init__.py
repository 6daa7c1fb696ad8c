"""tickframe: Spark-native analytics for financial event data."""

"""A Spark-native text search and analytics engine."""

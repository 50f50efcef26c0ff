"""A Spark-native engine for ranking and evaluating moments in large collections."""

"""A Spark-native engine for discovering recurring patterns in scored sequences."""

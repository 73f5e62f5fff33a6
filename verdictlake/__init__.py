"""A Spark-native engine for evidence-backed request review."""

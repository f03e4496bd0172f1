"""A Spark-native engine for retrieval over changing collections of text and vectors."""

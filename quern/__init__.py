"""A Spark-native engine for building, searching and measuring document corpora."""

"""Spark-native engine for structured knowledge, its documents, and corpus preparation."""

"""Spark-native document processing, retrieval and analytics."""

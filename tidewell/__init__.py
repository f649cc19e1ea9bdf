"""Spark-native retrieval, knowledge-graph and memory analytics."""

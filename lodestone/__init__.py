"""Spark-native retrieval, evaluation and corpus-processing engine."""

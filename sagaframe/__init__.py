"""Spark-native engine for story and dialogue corpora."""

"""Spark-native analytics over parsed contracts and document corpora."""

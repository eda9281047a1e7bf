"""Spark-native analytics over scholarly and other document-centred corpora."""
